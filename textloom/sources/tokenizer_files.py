"""Tokenizers from files: one tokenizer.json, or a directory with config, special-token and tokenizer-config files beside it."""

from __future__ import annotations

import json
from pathlib import Path


def load_tokenizer(path: str, max_length: int | None = None, pad_left: bool = False):
    """The tokenizer, with its special tokens and, for a directory, truncation and padding as its files say.

    A directory must state model_max_length and pad_token; pad_token_id is 0 where the config has none.
    """
    from tokenizers import AddedToken, Tokenizer

    if path.lstrip().startswith("{"):  # the JSON itself
        return Tokenizer.from_str(path)
    where = Path(path)
    if not where.exists():
        raise FileNotFoundError(path)
    if where.is_file():
        return Tokenizer.from_file(str(where))
    tok = Tokenizer.from_file(str(where / "tokenizer.json"))
    config, special, settings = (_json(where / n) for n in ("config.json", "special_tokens_map.json", "tokenizer_config.json"))
    if "model_max_length" not in settings:
        raise ValueError(f"{path}: tokenizer_config.json has no model_max_length")
    if "pad_token" not in settings:
        raise ValueError(f"{path}: tokenizer_config.json has no pad_token")
    limit = int(min(float(settings["model_max_length"]), 1 << 30))
    pad = settings["pad_token"]
    tok.enable_truncation(min(limit, max_length or limit))
    tok.enable_padding(direction="left" if pad_left else "right", pad_id=int(config.get("pad_token_id") or 0), pad_token=pad["content"] if isinstance(pad, dict) else pad)
    for entry in special.values():
        for token in entry if isinstance(entry, list) else [entry]:
            if isinstance(token, dict):
                tok.add_special_tokens([AddedToken(token["content"], single_word=token.get("single_word", False), lstrip=token.get("lstrip", False), rstrip=token.get("rstrip", False), normalized=token.get("normalized", True))])
            else:
                tok.add_special_tokens([token])
    return tok


def _json(path: Path) -> dict:
    return json.loads(path.read_text("utf-8"))


def find_snapshot(cache: str, model: str, names: tuple[str, ...]) -> str | None:
    """The newest revision of a model, in a cache of the hub's layout (models--owner--name/snapshots/revision/...), that has all these
    files: they belong together. A revision is as new as its newest file of them."""
    root = Path(cache) / ("models--" + model.replace("/", "--")) / "snapshots"
    whole = [r for r in root.iterdir() if all((r / n).is_file() for n in names)] if root.is_dir() else []
    return str(max(whole, key=lambda r: (max((r / n).stat().st_mtime for n in names), r.name))) if whole else None


def find_in_cache(cache: str, model: str, name: str = "tokenizer.json") -> str | None:
    """A file of a model in a cache of the hub's layout, of the newest revision that has it."""
    found = find_snapshot(cache, model, (name,))
    return str(Path(found) / name) if found else None
