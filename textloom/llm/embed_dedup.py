"""Near-duplicate vectors by a forest of random-projection trees.

1. Rows with the same label and the same components are one class: its smallest id stands for it.
2. A forest of `trees` trees is fitted on a sample of the classes, on the driver: a tree splits its nodes by random
   directions at the median of the sample's projections, and stops at about `leaf` classes a leaf, however many levels that
   takes; below those where the sample has rows enough, the nodes of a level are split at the whole sample's median. The
   sample has at most `sample` classes and `sample_bytes` bytes for each length of vectors. Every class is then
   indexed: it descends each tree, and into both children where its projection is within a margin of the split, which is
   `spill` standard deviations of the projected difference of two vectors that just link.
3. Classes are compared within leaves only, by their cosine in double precision. A leaf larger than `tile` is cut into
   blocks, and each pair of blocks is a task of its own, so nothing is capped. Two classes that share several leaves
   count where they share the first one.
4. A tile gives, for each class, how many rows it links with there, and edges that span the tile's components, never all
   pairs. The numbers are summed, the edges united to components over all trees.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label,
link with nothing and are their own component; vectors of different lengths do not link; rows that repeat an id are
vectors of their own, and take part in the component of their id; a null id has no component; labels may be of any type, ids
are whole numbers (others are refused); an empty table gives no rows; extra columns are ignored.

What a class costs: a row for each leaf it falls in, of its vector and 4 bytes for each of its leaves (8 beyond 2^32 leaves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import connected_components, prepare, written


def clean(rows: DataFrame) -> DataFrame:
    """id, label (as text), dim, digest, vec (raw components, in the column's own precision; null where the row links with nothing) over
    rows (id, v, label)."""
    kind = np.float64 if rows.schema["v"].dataType.elementType.typeName() == "double" else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat = col.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # a null is not a number
            edges = col.offsets.to_numpy()
            good = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[edges]
            full = np.concatenate(([0], np.cumsum(flat != 0)))[edges]
            use = (np.diff(good) == 0) & (np.diff(full) > 0) & col.is_valid().to_numpy(zero_copy_only=False) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
            dims = np.where(use, np.diff(edges), 0)
            vecs = [flat[edges[i] : edges[i + 1]].tobytes() if u else None for i, u in enumerate(use.tolist())]
            digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(dims.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "digest", "vec"])

    return rows.mapInArrow(run, "id bigint, label string, dim int, digest binary, vec binary")


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    flat = b"".join(raw)
    x = np.frombuffer(flat, np.float64 if len(flat) == 8 * dim * len(raw) else np.float32).reshape(len(raw), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    def __init__(self, sample: np.ndarray, total: int, trees: int, leaf: int, cosine: float, spill: float, seed: int = 11):
        n, dim = sample.shape
        rng = np.random.default_rng(seed + dim)
        self.depth = int(max(0, np.ceil(np.log2(max(total, 1) / leaf))))
        # down to where the sample has some rows a node, nodes have split points of their own; further levels have one each
        self.own = min(self.depth, int(np.floor(np.log2(max(n / 8, 1)))))
        self.margin = spill * np.sqrt(2 - 2 * cosine) / np.sqrt(dim)
        self.directions = rng.standard_normal((trees, self.depth, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits = np.zeros((trees, 1 << self.own))
        self.common = np.array([[np.median(sample @ self.directions[t, d]) for d in range(self.depth)] for t in range(trees)])
        for t in range(trees):
            node = np.ones(n, np.int64)
            for d in range(self.own):
                p = sample @ self.directions[t, d]
                order = np.lexsort((p, node))
                heads = np.flatnonzero(np.diff(node[order], prepend=-1))
                sizes = np.diff(np.append(heads, n))
                self.splits[t, node[order][heads]] = p[order][heads + sizes // 2]
                node = 2 * node + (p >= self.splits[t, node])

    def kind(self) -> str:
        """Of a leaf's number in a list."""
        return "<u4" if len(self.directions) << self.depth < 1 << 32 else "<u8"

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; leaves are numbered over all trees, the first tree's first."""
        who, where = [], []
        for t in range(len(self.directions)):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for d in range(self.depth):
                gap = (x @ self.directions[t, d])[row] - (self.splits[t, node] if d < self.own else self.common[t, d])
                low, high = gap < self.margin, gap >= -self.margin
                row, node = np.concatenate((row[low], row[high])), np.concatenate((2 * node[low], 2 * node[high] + 1))
            who.append(row)
            where.append((t << self.depth) + node - (1 << self.depth))
        return np.concatenate(who), np.concatenate(where)


def index(heads: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """A row for each leaf of each class: label, dim, leaf, id, rows, vec, all (its leaves)."""
    sent = heads.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = b.take(pa.array(np.flatnonzero(dims == dim)))
                    who, where = sent.value[int(dim)].leaves(unit(part.column("vec").to_pylist(), int(dim)))
                    order = np.lexsort((where, who))
                    who, where = who[order], where[order]
                    lists = np.split(where.astype(sent.value[int(dim)].kind()), np.flatnonzero(np.diff(who)) + 1)
                    packed = [x.tobytes() for x in lists]
                    rows = part.take(pa.array(who))
                    every = pa.array([packed[i] for i in who], pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("dim"), pa.array(where), rows.column("id"), rows.column("rows"), rows.column("vec"), every], ["label", "dim", "leaf", "id", "rows", "vec", "every"])

    return heads.mapInArrow(run, "label string, dim int, leaf bigint, id bigint, rows bigint, vec binary, every binary")


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float, kinds: dict[int, str]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, leaf = table.num_rows, table["leaf"][0].as_py()
        p, q, own = table["p"][0].as_py(), table["q"][0].as_py(), table["own"].to_numpy()
        ids, rows, x = table["id"].to_numpy(), table["rows"].to_numpy(), unit(table["vec"].to_pylist(), table["dim"][0].as_py())
        # the leaves before this one that classes of the tile share, as bits
        lists = [np.frombuffer(e, kinds[table["dim"][0].as_py()]) for e in table["every"].to_pylist()]
        flat, at = np.concatenate(lists), np.repeat(np.arange(n), [len(e) for e in lists])
        at, flat = at[flat < leaf], flat[flat < leaf]
        codes, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        bits = np.zeros((n, 1 + len(codes) // 64), np.uint64)
        use = times[code] > 1
        np.bitwise_or.at(bits, (at[use], code[use] >> 6), np.uint64(1) << (code[use] & 63).astype(np.uint64))
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        links, found_a, found_b = np.zeros(n, np.int64), [], []
        root = np.arange(n)
        for start in range(0, len(left), 256):
            i = left[start : start + 256]
            a, b = np.nonzero(x[i] @ x[right].T >= cosine)
            a, b = i[a], right[b]
            a, b = (a[a < b], b[a < b]) if p == q else (a, b)
            if not len(a):
                continue
            found_a.append(a)
            found_b.append(b)
            for s in range(0, len(a), 1 << 16):
                u, v = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                fresh = ~(bits[u] & bits[v]).any(axis=1)
                np.add.at(links, u[fresh], rows[v[fresh]])
                np.add.at(links, v[fresh], rows[u[fresh]])
            if sum(map(len, found_a)) > 1 << 21:  # keep what spans, not every pair
                root = _spanning(n, np.concatenate([*found_a, np.arange(n)]), np.concatenate([*found_b, root]))
                found_a, found_b = [], []
        root = _spanning(n, np.concatenate([*found_a, np.arange(n)]), np.concatenate([*found_b, root]))
        out = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table([pa.array(ids[out]), pa.array(links[out]), pa.array(ids[root[out]])], ["id", "links", "other"])

    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", trees: int = 5, leaf: int = 384, tile: int = 2048, sample: int = 20_000, sample_bytes: int = 32 << 20, spill: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    if not isinstance(rows.schema[vec_id].dataType, IntegralType):
        raise ValueError(f"ids are whole numbers, and {vec_id} is of type {rows.schema[vec_id].dataType.simpleString()}")
    prepare(rows.sparkSession)
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>" if "double" in rows.schema[embedding].dataType.simpleString() else "array<float>").alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    found = written(clean(base), "vectors")
    groups = found.filter("vec is not null and id is not null").groupBy("label", "digest").agg(F.min("id").alias("head"), F.count("*").alias("rows"))
    heads = written(found.filter("vec is not null").join(groups, ["label", "digest"]).filter("id = head").dropDuplicates(["label", "digest"]).select("id", "label", "dim", "vec", "rows"), "heads")
    forests = {}
    for r in heads.groupBy("dim").count().collect():  # a table of vectors has one length, seldom a few
        most = max(1, min(sample, sample_bytes // (8 * r["dim"])))
        fitted = heads.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id")).select("vec").limit(most).toArrow()
        forests[r["dim"]] = Forest(unit(fitted.column("vec").to_pylist(), r["dim"]), r["count"], trees, leaf, cosine, spill)
    entries = written(index(heads, forests), "leaves")
    keys = ["label", "dim", "leaf"]
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("m")).filter("m > 1").withColumn("m", F.ceil(F.col("m") / tile).cast("int"))
    placed = entries.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumns({"p": F.least("own", "q"), "q": F.greatest("own", "q")})
    told = written(placed.groupBy(*keys, "p", "q").applyInArrow(_compare(cosine, {d: f.kind() for d, f in forests.items()}), "id bigint, links bigint, other bigint"), "links")
    links = told.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(told.filter("id <> other"), "id", "other")
    per = groups.join(links, groups["head"] == links["id"], "left").drop("id").join(roots, F.col("head") == roots["node"], "left")
    per = per.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "head").alias("component_id"))
    out = found.select("id", "label", "digest").join(per, ["label", "digest"], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def digest(rows: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return near_duplicates(rows)


def keep_one(rows: DataFrame, **options) -> DataFrame:
    """The rows that are the first of their component, with their own columns; rows without an id stay."""
    gone = near_duplicates(rows, **options).filter("component_id < vec_id").select("vec_id").distinct()
    name = options.get("vec_id", "vec_id")
    return rows.join(gone.withColumnRenamed("vec_id", name), name, "left_anti").select(*rows.columns)
