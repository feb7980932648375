"""Layout of rows in batches for a forward pass, on lists inside a UDF, and as expressions on a position column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")
ATTEMPTS = 3
#: Heads of attention, bytes of a float, and two copies of the scores.
_HEADS, _FLOAT, _COPIES = 16, 4, 2


def chunked(rows: Sequence[T], size: int) -> Iterator[Sequence[T]]:
    """Runs of `size` rows in order; the last may be shorter."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    for start in range(0, len(rows), size):
        yield rows[start : start + size]


def pinned(rows: Sequence[T], size: int, ruler: T) -> tuple[list[T], list[int]]:
    """Rows in batches of one shape: each led by the ruler, the last filled with it; and where the real rows are."""
    if size < 2:
        raise ValueError("a pinned batch holds the ruler and a row")
    out, at = [], []
    for chunk in chunked(rows, size - 1):
        out.append(ruler)
        at.extend(range(len(out), len(out) + len(chunk)))
        out.extend(chunk)
        out.extend([ruler] * (size - 1 - len(chunk)))
    return out, at


def unpinned(results: Sequence[T], at: Sequence[int]) -> list[T]:
    """The results of the real rows, in order."""
    if at and max(at) >= len(results):
        raise ValueError(f"{len(results)} results do not reach row {max(at)}")
    return [results[i] for i in at]


def settled(run: Callable[[], Sequence[T]], expected: int, attempts: int = ATTEMPTS) -> Sequence[T]:
    """Runs until as many rows come back as went in, `attempts` times at most."""
    said = ""
    for _ in range(max(attempts, 1)):
        try:
            got = run()
        except RuntimeError as e:
            said = str(e)
            continue
        if len(got) == expected:
            return got
        said = f"{len(got)} rows of {expected}"
    raise RuntimeError(f"the pass did not settle: {said}")


def attention_bytes(batch: int, length: int) -> int:
    """Peak bytes of one layer's attention scores."""
    return batch * _HEADS * length * length * _FLOAT * _COPIES


def should_pin(setting: str | None, providers: list[str]) -> bool:
    """An explicit on or off wins; otherwise only where shapes are compiled ahead."""
    word = (setting or "").strip().lower()
    if word in ("1", "on", "true", "yes"):
        return True
    if word in ("0", "off", "false", "no"):
        return False
    if word:
        raise ValueError(f"expected on or off, not {setting!r}")
    return "MIGraphXExecutionProvider" in providers


def batch_of(position: Column, size: int) -> Column:
    return F.floor(position / size)


def pinned_place(position: Column, size: int) -> Column:
    """The row's place among pinned rows."""
    return position + F.floor(position / (size - 1)) + 1
