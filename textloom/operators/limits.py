"""Limits of requests: on the driver for one request, and as expressions for a table of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds and defaults of a request.
MIN_LENGTH, MAX_LENGTH = 16, 8192
DEFAULT_LENGTH, DEFAULT_BATCH = 256, 64
MOST_TOKENIZE_ROWS = 4096


@dataclass(frozen=True)
class Limits:
    max_length: int
    max_batch: int


def effective(max_length: int = 0, max_batch: int = 0, default_length: int = DEFAULT_LENGTH, default_batch: int = DEFAULT_BATCH) -> Limits:
    """0 means the default; lengths are clamped to MIN_LENGTH..MAX_LENGTH, batches to 1 at least."""
    if max_length < 0 or max_batch < 0:
        raise ValueError("limits are not negative")
    return Limits(min(max(max_length or default_length, MIN_LENGTH), MAX_LENGTH), max(max_batch or default_batch, 1))


def effective_length(requested: Column, default: int = DEFAULT_LENGTH) -> Column:
    return F.least(F.greatest(F.when(requested == 0, F.lit(default)).otherwise(requested), F.lit(MIN_LENGTH)), F.lit(MAX_LENGTH))


def effective_batch(requested: Column, default: int = DEFAULT_BATCH) -> Column:
    return F.greatest(F.when(requested == 0, F.lit(default)).otherwise(requested), F.lit(1))


def cap_for(kind: str | None, requested: int, resident: int | None) -> int:
    """A query takes the cap of the model that is loaded, if any; every other kind states its own."""
    return resident if kind == "query" and resident is not None else requested


def cap(kind: Column, requested: Column, resident: Column) -> Column:
    return F.when(kind == "query", F.coalesce(resident, requested)).otherwise(requested)


def truncated(n_tokens: Column, max_length: int | Column) -> Column:
    """Whether a text is longer than the cap; null if its length is unknown."""
    return n_tokens > (F.lit(max_length) if isinstance(max_length, int) else max_length)


def refuse_beyond(rows: DataFrame, most: int = MOST_TOKENIZE_ROWS) -> DataFrame:
    """The rows, or an error if there are more than `most`; opt-in, as a distributed job needs no such cap."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; send fewer, none are dropped")
    return rows


def one_of(name: str | None, default: str, known: list[str]) -> str:
    """The name, or the default for none; an error that lists the known names for another."""
    found = name or default
    if found not in known:
        raise ValueError(f"unknown tokenizer {found!r}; known: {', '.join(sorted(known))}")
    return found
