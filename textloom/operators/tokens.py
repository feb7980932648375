"""Token counting with truncation accounting.

Unknown is a value: a text that the tokenizer refuses has a null count, never 0, and one unknown text leaves the whole
request unmeasured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import spans
from ..sources.tokenizer_files import load_tokenizer
from ..session import ship_active
from .batching import parts
from .limits import one_of, truncated

_loaded: dict[str, object] = {}


@dataclass
class TokenizerRegistry:
    """Names to paths of tokenizer files; a name may be registered without being available."""

    paths: dict[str, str | None]
    default: str
    status: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, path in self.paths.items():
            try:
                self.status[name] = "absent" if path is None else "available" if load_tokenizer(path) else "absent"
            except FileNotFoundError:
                self.status[name] = "absent"
            except Exception as e:  # a file that cannot be read is not one that is not there
                self.status[name] = f"unreadable: {e}"

    def resolve(self, name: str | None) -> str:
        return one_of(name, self.default, list(self.paths))

    def available(self, name: str) -> bool:
        return self.status.get(name) == "available"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, self.available(n), s) for n, s in self.status.items()], "name string, available boolean, status string")


def _tokenizer(path: str):
    """The tokenizer of this worker, which neither cuts nor pads."""
    if path not in _loaded:
        _loaded[path] = load_tokenizer(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


def counter(path: str | None):
    """A UDF: the number of tokens, special ones included, without truncation; null for a text that is refused or null."""
    ship_active()

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (part for batch in batches for part in parts(batch)):
            yield pa.array(_counts(path, texts.to_pylist()), pa.int32())

    return count


def request_counter(path: str | None):
    """The same for arrays of texts; a null array is an empty one."""
    ship_active()

    @F.arrow_udf("array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (requests,) in (part for batch in batches for part in parts(batch)):
            yield pa.array([_counts(path, x or []) for x in requests.to_pylist()], pa.list_(pa.int32()))

    return count


def routed_counter(paths: dict[str, str]):
    """A UDF from the name of a tokenizer and an array of texts to their numbers of tokens; null for a name without a path."""
    ship_active()

    @F.arrow_udf("array<int>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, requests in (part for batch in batches for part in parts(*batch)):
            pairs = zip(names.to_pylist(), requests.to_pylist())
            yield pa.array([_counts(paths[n], x or []) if n in paths else None for n, x in pairs], pa.list_(pa.int32()))

    return count


def span_finder(path: str, wanted: int):
    """A UDF from text to the runs of one token id: array<struct<start, end>>, positions of tokens, the end not in it; null of null."""
    ship_active()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (part for batch in batches for part in parts(batch)):
            rows = texts.to_pylist()
            encoded = iter(_tokenizer(path).encode_batch([t for t in rows if t is not None]))
            yield pa.array([None if t is None else [{"start": a, "end": b} for a, b in spans(np.array(next(encoded).ids), wanted)] for t in rows], kind)

    return find


def _counts(path: str | None, texts: list[str | None]) -> list[int | None]:
    if path is None:
        return [None] * len(texts)
    tok, out = _tokenizer(path), []
    for start in range(0, len(texts), 256):
        part = texts[start : start + 256]
        known = [t for t in part if t is not None]
        try:
            found = iter([len(x) for x in tok.encode_batch(known)])
        except Exception:  # one of them is refused
            found = iter([_count(tok, t) for t in known])
        out += [None if t is None else next(found) for t in part]
    return out


def _count(tok, text: str) -> int | None:
    try:
        return len(tok.encode(text))
    except Exception:  # refusal of this text
        return None


def with_counts(df: DataFrame, text: str, path: str | None, max_length: int | None = None) -> DataFrame:
    """Adds n_tokens and, with a cap, truncated. Only these are computed; other columns pass by the UDF."""
    out = df.withColumn("n_tokens", counter(path)(F.col(text)))
    return out if max_length is None else out.withColumn("truncated", truncated(F.col("n_tokens"), max_length))


def usage(counted: DataFrame, request: str, position: str, max_length: int, n_tokens: str = "n_tokens") -> DataFrame:
    """For each request: token_count and truncated in order of position, max_length, token_accounting.

    With any unknown count both arrays are null and token_accounting is false; max_length is stated all the same.
    """
    n = F.col(n_tokens)
    known = F.bool_and(n.isNotNull())
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), n.alias("n"))))
    counts = F.transform(rows, lambda x: x["n"])
    grouped = counted.groupBy(request).agg(known.alias("token_accounting"), counts.alias("_n"))
    shown = grouped.withColumn("token_count", F.when(F.col("token_accounting"), F.col("_n")))
    return shown.select(request, "token_count", F.transform("token_count", lambda x: x > max_length).alias("truncated"), F.lit(max_length).alias("max_length"), "token_accounting")


def truncated_count(n_tokens: Column, max_length: int) -> Column:
    """An aggregate: how many texts are longer than the cap."""
    return F.count_if(truncated(n_tokens, max_length))
