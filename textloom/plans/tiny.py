"""A tiny model and tokenizer, made here, for queries and tests without model files: an embedding look-up by token id.

The model's file is written in the wire format of protocol buffers by hand, as the package that makes such files is not
a requirement.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from ..operators.encode import WHOLE, Encoder
from ..sources.head_weights import write_tensors


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _value_info(name: str, kind: int, dims: list[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _tensor(name: str, x: np.ndarray) -> bytes:
    kind = {np.dtype("float32"): 1, np.dtype("int64"): 7}[x.dtype]
    return b"".join(_field(1, d) for d in x.shape) + _field(2, kind) + _field(8, name) + _field(9, x.tobytes())


def _node(kind: str, inputs: list[str], outputs: list[str]) -> bytes:
    return b"".join(_field(1, i) for i in inputs) + b"".join(_field(2, o) for o in outputs) + _field(4, kind)


def gather_model(tables: dict[str, np.ndarray], pooled_names: tuple[str, ...] = ()) -> bytes:
    """A model from input_ids to an output for each table: the rows of the ids, or, for names that start with pooled_ or are in
    `pooled_names`, the row of the first id."""
    nodes, weights, outputs = b"", b"", b""
    first = {n for n in tables if n.startswith("pooled_") or n in pooled_names}
    for name, table in tables.items():
        pooled = name in first
        nodes += _field(1, _node("Gather", [f"{name}_table", "first_id" if pooled else "input_ids"], [name]))
        weights += _field(5, _tensor(f"{name}_table", table.astype(np.float32)))
        outputs += _field(12, _value_info(name, 1, ["batch", "dimension"] if pooled else ["batch", "length", "dimension"]))
    if first:
        axis = _field(1, "axis") + _field(3, 1) + _field(20, 2)
        nodes = _field(1, _node("Gather", ["input_ids", "zero"], ["first_id"]) + _field(5, axis)) + nodes
        weights += _field(5, _field(2, 7) + _field(8, "zero") + _field(9, np.zeros(1, np.int64).tobytes()))
    graph = nodes + _field(2, "tiny") + weights + _field(11, _value_info("input_ids", 7, ["batch", "length"])) + outputs
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def sum_model(table: np.ndarray, name: str = "logits", source: str = "input_ids") -> bytes:
    """A model from ids (of tokens, or of another input) to the sum of their rows."""
    nodes = _field(1, _node("Gather", ["table", source], ["rows"])) + _field(1, _node("ReduceSum", ["rows", "axes"], [name]) + _field(5, _field(1, "keepdims") + _field(3, 0) + _field(20, 2)))
    weights = _field(5, _tensor("table", table.astype(np.float32))) + _field(5, _tensor("axes", np.array([1], np.int64)))
    graph = nodes + _field(2, "tiny") + weights + _field(11, _value_info(source, 7, ["batch", "length"])) + _field(12, _value_info(name, 1, ["batch", "dimension"]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def tiny_tokenizer(words: list[str]) -> str:
    """The JSON of a tokenizer that knows these words, with an id for all others."""
    vocab = {"[UNK]": 0} | {w: i + 1 for i, w in enumerate(words)}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}})


def template_tokenizer(words: list[str]) -> str:
    """The same tokenizer, with [B] before a text and [E] after it and after a second one, whose tokens are of type 1."""
    d = json.loads(tiny_tokenizer([*words, "[B]", "[E]"]))
    mark = lambda name, kind: {"SpecialToken": {"id": name, "type_id": kind}}
    text = lambda name, kind: {"Sequence": {"id": name, "type_id": kind}}
    single = [mark("[B]", 0), text("A", 0), mark("[E]", 0)]
    special = {n: {"id": n, "ids": [d["model"]["vocab"][n]], "tokens": [n]} for n in ("[B]", "[E]")}
    d["post_processor"] = {"type": "TemplateProcessing", "single": single, "pair": [*single, text("B", 1), mark("[E]", 1)], "special_tokens": special}
    return json.dumps(d)


def space_tokenizer() -> str:
    """The JSON of a tokenizer that splits at spaces and knows no word."""
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"[UNK]": 0}, "unk_token": "[UNK]"}})


WORDS = "the and that of with be is for in to de la que le et der die und el los".split()


def formula_table(dimension: int) -> np.ndarray:
    """A look-up table that SQL can state, too: ((7 id + 3 place) mod 11 - 5) / 4; exact in single precision."""
    return ((7 * np.arange(len(WORDS) + 1)[:, None] + 3 * np.arange(dimension)) % 11 - 5) / 4.0


def formula_encoder(outputs: dict[str, int], max_length: int = WHOLE, batch_size: int = 64, **settings) -> Encoder:
    """A model with these outputs (name: dimension), each a look-up in the formula's table, over the tiny tokenizer."""
    return Encoder(model=gather_model({n: formula_table(d) for n, d in outputs.items()}), tokenizer=tiny_tokenizer(WORDS), max_length=max_length, batch_size=batch_size, **settings)


def scoring_table() -> np.ndarray:
    """((7 id) mod 11 - 5) / 64 for known words, 0 for others and for padding."""
    return np.where(np.arange(len(WORDS) + 1) > 0, ((7 * np.arange(len(WORDS) + 1)) % 11 - 5) / 64, 0.0)[:, None]


def scoring_encoder(**settings) -> Encoder:
    """A reranker whose logit is the sum over both texts' words of the scoring table."""
    return Encoder(**{"model": sum_model(scoring_table()), "tokenizer": tiny_tokenizer(WORDS), "head": "rerank", "max_length": WHOLE, "batch_size": 64} | settings)


def hub_cache(where: str, code: str, files: dict[str, bytes]) -> str:
    """A cache of the hub's layout with one revision of one model: these files and the tiny tokenizer's."""
    root = Path(where) / ("models--" + code.replace("/", "--")) / "snapshots" / "only"
    plain = {"tokenizer.json": tiny_tokenizer(WORDS), "config.json": "{}", "special_tokens_map.json": "{}", "tokenizer_config.json": json.dumps({"model_max_length": WHOLE, "pad_token": "[UNK]"})}
    for name, body in ({n: t.encode() for n, t in plain.items()} | files).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return str(where)


def two_headed(where: str, weight: tuple[float, ...], bias: float) -> str:
    """A cache in which the registry's model with two heads is a look-up in the formula's table, with a head of these weights."""
    table = formula_table(len(weight))
    model = gather_model({"sentence_embedding": table, "token_embeddings": table}, ("sentence_embedding",))
    head = write_tensors({"weight": np.array([weight]), "bias": np.array([bias])})
    return hub_cache(where, "BAAI/bge-m3", {"onnx/model.onnx": model, "onnx/model.onnx_data": b"", "sparse_linear.safetensors": head})


def tiny_encoder(dimension: int = 8, max_length: int = 64, batch_size: int = 64, **settings) -> Encoder:
    table = np.random.default_rng(3).standard_normal((len(WORDS) + 1, dimension))
    return Encoder(model=gather_model({"last_hidden_state": table}), tokenizer=tiny_tokenizer(WORDS), pooling="mean", max_length=max_length, batch_size=batch_size, **settings)
