"""Whitening of embeddings: integer sums give the mean, a second pass the covariance, its eigenvectors the projection.

An entry c becomes the integer x = floor(64 c) + 1000000. The first pass adds the x of each dimension exactly (in two halves of
32 bits, so that no sum overflows). With m = floor(S / n) and r = S - n m, an x less its mean is (x - m) - r / n: an exact small integer less
a number below 1, so no digits are lost before multiplying. The second pass adds the outer products of these by matrix
multiplication, one matrix a task; treeAggregate merges the tasks' matrices on the executors. LAPACK's symmetric eigh on the
driver gives the components; their projection is broadcast. A third pass adds the outer products of the whitened rows, centred
by their own mean, which is how far they are from the identity.

Bounds: with D dimensions a task holds a batch and D x D doubles, the driver D x D doubles (8 MB at 1,024), the broadcast D x 32.
No row leaves its task. A lost executor costs the tasks it had: every pass reads the table again.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out; so are those of another length
than the most frequent one (of lengths as frequent, the longest), as they have no common dimensions. Entries beyond 2^61 / 64
in size are held there. Rows that repeat are rows each; a null id is kept as it is. Components are as many as the dimensions,
`components` at most; each is turned so that its largest entry (the first of equal ones) is positive. A component without variance
(below the rounding of the largest eigenvalue), as all have where all vectors are equal, has a null `whitened` and no part in
identity_error, which is null where no component has variance; so is `explained` where there is no variance at all. A deviation
beyond 2^63 - 1 is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries as integers are held between these.
MOST = 1 << 61
#: Rows that are worked on at once.
ROWS = 4096
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whitening:
    """What the passes found: rows, mean as quotient and rest, projection (dimensions x components, already over sqrt(e)), share of variance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    spread: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean."""
        return (x - self.whole) - self.rest.astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row."""
        y = x - self.whole
        if y.shape[1] * ((float(np.abs(y).max(initial=0)) + 1) * self.n) ** 2 < 2.0**62:
            d = y * self.n - self.rest
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - self.rest.astype(object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def integers(col: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: places of the rows that count, and their entries as integers."""
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    edges = col.offsets.to_numpy()
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[edges]
    at = np.flatnonzero((np.diff(bad) == 0) & (np.diff(edges) == dimension) & col.is_valid().to_numpy(zero_copy_only=False))
    c = flat[edges[:-1][at, None] + np.arange(dimension)] if len(at) else np.zeros((0, dimension))
    return at, np.clip(np.floor(64 * np.clip(c, -(2.0**60), 2.0**60)), -MOST, MOST).astype(np.int64) + 1_000_000


def _batches(batches: Iterator[pa.RecordBatch], column: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        at, x = integers(batch.column(column), dimension)
        for start in range(0, len(at), ROWS):
            yield batch, at[start : start + ROWS], x[start : start + ROWS]


def _merged(rows: DataFrame, add):
    """treeAggregate over the one row of arrays that each task gave; None without rows."""
    return rows.rdd.map(lambda r: tuple(np.frombuffer(b, k) for b, k in zip(r, ("i8", "i8", "i8") if len(r) == 3 else ("f8", "f8")))).treeAggregate(None, add, add)


def _add_sums(a, b):
    if a is None or b is None:
        return b if a is None else a
    n, high, low = (x + y for x, y in zip(a, b))
    return n, high + (low >> 32), low & _LOW


def _add_products(a, b):
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b))


def _sums(rows: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for _, at, x in _batches(batches, 0, dimension):
            n += len(at)
            high += (x >> 32).sum(axis=0)
            low += (x & _LOW).sum(axis=0)
            high, low = high + (low >> 32), low & _LOW
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (np.array([n]), high, low)], ["n", "high", "low"])

    found = _merged(rows.mapInArrow(run, "n binary, high binary, low binary"), _add_sums)
    return (0, []) if found is None else (int(found[0][0]), [(int(h) << 32) + int(v) for h, v in zip(found[1], found[2])])


def _products(rows: DataFrame, dimension: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums of project(x) and of its outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = products = None
        for _, _, x in _batches(batches, 0, dimension):
            z = project(x)
            total = z.sum(axis=0) if total is None else total + z.sum(axis=0)
            products = z.T @ z if products is None else products + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (total, products)], ["total", "products"])

    total, products = _merged(rows.mapInArrow(run, "total binary, products binary"), _add_products)
    return total, products.reshape(len(total), len(total))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all vectors that count; None if there are none."""
    if components < 1:
        raise ValueError("components is at least 1")
    common.prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    usable = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    top = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not top:
        return None
    dimension = top[0].d
    n, sums = _sums(rows, dimension)
    whole = np.array([s // n for s in sums], np.int64)
    mean = Whitening(n, whole, np.array([s - n * int(m) for s, m in zip(sums, whole)], np.int64), *[np.zeros(0)] * 3)
    total, products = _products(rows, dimension, mean.centred)
    covariance = products / n
    values, found = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, found, trace = np.maximum(values[order], 0.0), found[:, order], float(np.trace(covariance))
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    spread = values > values[0] * dimension * np.finfo(np.float64).eps
    fitted = Whitening(n, mean.whole, mean.rest, found / np.sqrt(np.where(spread, values, 1.0)), values / trace if trace > 0 else np.full(len(values), np.nan), spread)
    if not spread.any():
        return fitted
    p = fitted.projection[:, spread]
    sent = vectors.sparkSession.sparkContext.broadcast(p)
    own = total / n @ p  # the mean of what rounding leaves
    _, products = _products(rows, dimension, lambda x: mean.centred(x) @ sent.value - own)
    return replace(fitted, identity_error=float(np.abs(products / n - np.eye(len(own))).max()))


def whiten(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """vector_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error: a row for each vector
    that counts and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = fit(vectors, vector, components)
    if found is None:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", vector_id)
    sent = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        k, dimension = w.projection.shape[1], len(w.whole)
        for batch, at, x in _batches(batches, 1, dimension):
            white = np.where(w.spread, w.centred(x) @ w.projection, np.nan).ravel()
            each = lambda v: pa.array(np.tile(v, len(at)), from_pandas=True)
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    each(np.arange(1, k + 1, dtype=np.int32)),
                    each(np.full(k, w.n, np.int64)),
                    pa.array(w.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(white, from_pandas=True),
                    each(w.explained),
                    each(np.full(k, np.nan if w.identity_error is None else w.identity_error)),
                ],
                names,
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("vec_id", vector_id)
