"""Which rows share a forward pass: rows of about one length, padded to one of a few lengths, within a bound on the pass's memory.

A text of n tokens is padded to the smallest length of the ladder 16, 24, 32, 48, 64, 96, ... that holds it (never beyond the
model's cap, which is a length of its own). A pass of one length has as many rows as the batch size and the bound on attention's
memory allow, one at least. So less than a third of a pass is padding (for texts of 16 tokens and more), no long text makes
short ones long, and a model sees few shapes: with filled passes, one a length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import release
from .layout import attention_bytes

#: The least length, and bytes of attention scores that a pass may take.
LEAST, BUDGET = 16, 1 << 30
#: Bytes of text and rows that are tokens, vectors and results in a worker's memory at once, whatever Arrow's batches hold.
PART_BYTES, PART_ROWS = 1 << 20, 1024


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of text of each row of strings or of lists of strings, 16 more for each string; 0 of other types."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sums, edges = np.concatenate(([0], np.cumsum(_bytes(column.values)))), column.offsets.to_numpy()
        return sums[edges[1:]] - sums[edges[:-1]]
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    return np.zeros(len(column), np.int64)


def parts(*columns: pa.Array, whole: bool = False, most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in runs of rows with about `most` bytes of text, `rows` rows at most (a longer row stands alone); all at once if `whole`.
    Freed memory goes back after each."""
    n, start = len(columns[0]), 0
    if whole or not n:
        yield columns
        return
    sums = np.cumsum(sum(_bytes(c) for c in columns))
    while start < n:
        base = sums[start - 1] if start else 0
        end = min(n, start + rows, max(start + 1, int(np.searchsorted(sums, base + most, side="right"))))
        yield tuple(c.slice(start, end - start) for c in columns)
        release()
        start = end


@dataclass(frozen=True)
class Pass:
    """A forward pass: places of its rows, the length that they are padded to, and the rows it is filled up to."""

    at: tuple[int, ...]
    length: int
    rows: int


def ladder(cap: int, most: int | None = None, least: int = LEAST) -> list[int]:
    """The lengths up to `cap`, ascending, as far as they are needed for texts of `most` tokens."""
    if cap < 1:
        raise ValueError("a text has room for a token at least")
    found, step = [], least
    top = cap if most is None else min(cap, max(most, 1))
    while not found or found[-1] < top:
        found.append(min(step, cap))
        if found[-1] < top and step + step // 2 < 2 * step:
            found.append(min(step + step // 2, cap))
        step *= 2
    return found


def rows_of(length: int, batch_size: int, budget: int = BUDGET) -> int:
    """Rows of a pass of this length."""
    return max(1, min(batch_size, budget // attention_bytes(1, length)))


def passes(lengths: Sequence[int], cap: int, batch_size: int, budget: int = BUDGET, fixed: bool = False, filled: bool = False) -> list[Pass]:
    """Every row in one pass, shortest first, rows of one length in their order. fixed: all are padded to the cap; filled: all passes
    of a length have one number of rows."""
    if batch_size < 1:
        raise ValueError("a batch holds at least one row")
    steps = [cap] if fixed else ladder(cap, max(lengths, default=1))
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(steps[min(bisect_left(steps, n), len(steps) - 1)], []).append(i)
    out = []
    for length in sorted(by):
        rows = rows_of(length, batch_size, budget)
        for start in range(0, len(by[length]), rows):
            at = tuple(by[length][start : start + rows])
            out.append(Pass(at, length, rows if filled else len(at)))
    return out


def padded_length(n_tokens: Column, cap: int) -> Column:
    """The length of the ladder that a text of so many tokens is padded to; null for an unknown count."""
    steps = ladder(cap, None if cap <= 1 << 20 else 1 << 31)
    found = F.element_at(F.filter(F.array(*[F.lit(s).cast("bigint") for s in steps]), lambda s: s >= F.least(n_tokens, F.lit(cap))), 1)
    return F.when(n_tokens.isNotNull(), found)


def pass_rows(length: Column, batch_size: int, budget: int = BUDGET) -> Column:
    """Rows of a pass of this length."""
    one = attention_bytes(1, 1)
    return F.greatest(F.lit(1), F.least(F.lit(batch_size), F.floor(F.lit(budget) / (length.cast("double") * length * one))))
