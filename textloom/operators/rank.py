"""Similarity search and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, sigmoid
from ..session import release, ship, small_batches

#: Bytes of query vectors in a block, and in all blocks of a join whose query side is broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 8 << 20
#: Cells of a product of queries and corpus rows that are worked on at once.
CELLS = 1 << 20


def _matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which vectors are known (not null, every component finite), these as a matrix in double precision,
    cut or filled with zeros to `dim`, and their norms."""
    flat, edges = col.values.to_numpy(zero_copy_only=False).astype(np.float64), col.offsets.to_numpy()
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[edges]
    known = np.flatnonzero((np.diff(bad) == 0) & col.is_valid().to_numpy(zero_copy_only=False))
    start, size = edges[:-1][known], np.diff(edges)[known]
    dim = int(size.max(initial=0)) if dim is None else dim
    place = start[:, None] + np.arange(dim)
    out = np.where(np.arange(dim) < size[:, None], flat[np.minimum(place, max(len(flat) - 1, 0))] if len(flat) else 0.0, 0.0)
    squares = np.concatenate(([0.0], np.cumsum(np.where(np.isfinite(flat), flat, 0.0) ** 2))) if (size > dim).any() else None
    norms = np.sqrt((out * out).sum(axis=1)) if squares is None else np.sqrt([(flat[i : i + n] ** 2).sum() for i, n in zip(start, size)])
    return known, out, norms


def _body(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def query_blocks(queries: DataFrame, query_id: str, query_vector: str) -> tuple[DataFrame, int]:
    """block, body: queries (q, v, h, copies) in blocks of about BLOCK_BYTES, and the bytes of all. Rows that are wholly equal are one query with
    its number of copies, so that no block fills up with them; h is a hash of the vector, which tells queries of one id apart."""
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("q is not null and v is not null")
    size = 8 * (asked.agg(F.sum(F.size("v") + 2)).first()[0] or 0)
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = asked.groupBy("q", "v").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("q", "v"), F.lit(blocks)))

    def run(rows: pa.Table) -> pa.Table:
        body = _body(rows.select(["q", "v", "h", "copies"]).combine_chunks().to_batches()[0])
        return pa.table({"block": rows.column("block").slice(0, 1).cast(pa.int64()), "body": pa.array([body], pa.binary())})

    return dealt.groupBy("block").applyInArrow(run, "block bigint, body binary"), size


def corpus_blocks(corpus: DataFrame, corpus_id: str, corpus_vector: str, shards: int) -> DataFrame:
    """shard, rows: the corpus in blocks of about BLOCK_BYTES, one or more of each Arrow batch, dealt to shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            step = max(1, batch.num_rows // max(1, -(-batch.nbytes // BLOCK_BYTES)))
            for start in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([turn % shards], pa.int32()), pa.array([_body(batch.slice(start, step))], pa.binary())], ["shard", "rows"])
                turn += 1

    base = corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return base.mapInArrow(run, "shard int, rows binary")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "id", query_vector: str = "vector", corpus_id: str = "id", corpus_vector: str = "vector") -> DataFrame:
    """query_id, id, rank, score: for each query the k corpus rows of the largest cosine, ties by smaller id. Vectors that are
    null or have components that are null or not finite are unknown: they are no results, and have none; so are rows without id. Ids may
    be of any type with an order. Each query row has k results of its own: rows that repeat an id are ranked apart.

    Queries travel in blocks to the corpus, which is read once and stays where it is while the blocks of all queries are small enough to
    be broadcast (BROADCAST_BYTES, measured first); beyond that both sides meet in shards. A pair of blocks is one
    matrix product, of which each query keeps its k best; Spark keeps the k best of each task before the last shuffle.
    Nothing passes through the driver's Python, and no pair beyond k a pair of blocks becomes a row.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    spark = queries.sparkSession
    ship(spark)
    small_batches(spark)
    kinds = queries.schema[query_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString()
    blocks, size = query_blocks(queries, query_id, query_vector)
    shards = 1 if size <= BROADCAST_BYTES else max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = blocks.select("body", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = corpus_blocks(corpus, corpus_id, corpus_vector, shards).join(F.broadcast(sent) if shards == 1 else sent, "shard").select("rows", "body")
    best = met.mapInArrow(_best_of(k), f"query_id {kinds[0]}, h bigint, copies bigint, id {kinds[1]}, score double")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "rank", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("col")


def _best_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, body in zip(batch.column(0), batch.column(1)):
                yield from _best(_table(rows.as_buffer()), _table(body.as_buffer()), k)
            release()

    return run


def _best(rows: pa.Table, asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block's rows for each query of a block."""
    there, q, q_norms = _matrix(asked.column("v").combine_chunks())
    known, x, norms = _matrix(rows.column("v").combine_chunks(), q.shape[1])
    if not len(known) or not len(there):
        return
    ids = rows.column("id").combine_chunks()
    order = np.argsort(ids.to_numpy(zero_copy_only=False)[known], kind="stable")
    known, x, norms = known[order], x[order], norms[order]
    n = min(k, len(known))
    step = max(1, CELLS // len(known))
    for start in range(0, len(there), step):
        part = slice(start, start + step)
        length = q_norms[part, None] * norms[None, :]
        scores = np.round(np.where(length > 0, (q[part] @ x.T) / np.where(length > 0, length, 1), 0.0), 9)
        # all that reach the n-th best score, then in order of score and id
        who, at = np.nonzero(scores >= np.partition(scores, len(known) - n, axis=1)[:, len(known) - n, None])
        by = np.lexsort((at, -scores[who, at], who))
        who, at = who[by], at[by]
        top = np.arange(len(who)) - np.searchsorted(who, who) < n
        who, at = who[top], at[top]
        of = pa.array(there[part][who])
        own = [asked.column(c).combine_chunks().take(of) for c in ("q", "h", "copies")]
        yield pa.RecordBatch.from_arrays([*own, ids.take(pa.array(known[at])), pa.array(scores[who, at])], ["query_id", "h", "copies", "id", "score"])


def top_k_native(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "id", query_vector: str = "vector", corpus_id: str = "id", corpus_vector: str = "vector") -> DataFrame:
    """The same for a single query, in expressions only: one pass and the k largest of each task."""
    one = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).limit(2).collect()
    if len(one) != 1:
        raise ValueError("top_k_native takes one query; use top_k for more")
    if one[0].q is None or one[0].v is None or not all(x is not None and np.isfinite(x) for x in one[0].v):
        corpus, one = corpus.limit(0), [one[0].asDict() | {"v": []}]
        one = [type("Row", (), one[0])]
    vector = F.array(*[F.lit(float(x)) for x in one[0].v])
    known = F.col(corpus_vector).isNotNull() & ~F.exists(corpus_vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    score = corpus.filter(F.col(corpus_id).isNotNull() & known).select(F.col(corpus_id).alias("id"), F.round(cosine(vector, F.col(corpus_vector)), 9).alias("score"))
    top = score.orderBy(F.desc("score"), "id").limit(k)
    return top.select(F.lit(one[0].q).alias("query_id"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")


def rerank(pairs: DataFrame, request: str, position: str, raw: Column, document: str | None = None, n: int | None = None, ranges: int | None = None) -> DataFrame:
    """request, rank, index, raw and, on demand, document: best first; ties keep the input's order, unknown logits come last.

    `raw` is the scorer's first logit: a UDF over query and document, or any expression. n: only the best n of each request, which Spark
    finds in each task before it shuffles. ranges: ranks of requests with very many documents are found in so many ranges of
    scores at least (see `spread_ranks`), so that no task holds all of a request; else a request is sorted in one task.
    """
    if n is not None and n < 1:
        raise ValueError("n is at least 1")
    scored = pairs.select(request, F.col(position).alias("index"), raw.alias("raw"), *([F.col(document).alias("document")] if document else []))
    if ranges is not None and n is None:
        return spread_ranks(scored, request, ranges)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(F.desc("raw"), "index")))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def spread_ranks(scored: DataFrame, request: str, ranges: int = 64) -> DataFrame:
    """Adds `rank` as `rerank` does, for rows (request, index, raw, ...) of a table, as they are read several times.

    Requests with more than 1 / (2 ranges) of all rows, of which there are 2 * ranges at most, are cut into ranges by quantiles of their
    logits, and ranges of one logit only by quantiles of their index. Each range is ranked by itself; the rows of the ranges before it are
    added. Only the two sets of quantiles and the counts of ranges are gathered for a request: 2 ranges^3 numbers at most are broadcast.
    """
    if not 2 <= ranges <= 128:
        raise ValueError("ranges are 2 to 128")
    total = scored.count()
    sizes = scored.groupBy(F.col(request).alias("_r")).agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") * 2 * ranges > total).select("_r")
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    large = scored.join(F.broadcast(hot), F.col(request).eqNullSafe(F.col("_r")), "left_semi")
    small = scored.join(F.broadcast(hot), F.col(request).eqNullSafe(F.col("_r")), "left_anti")

    def cut(rows: DataFrame, keys: list[str], more: DataFrame) -> DataFrame:
        """Rows with the columns of a small table of the same keys."""
        same = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]
        return rows.join(F.broadcast(more.select(*[F.col(k).alias(f"_of{k}") if k in keys else F.col(k) for k in more.columns])), same).drop(*[f"_of{k}" for k in keys])

    first = cut(large, [request], large.groupBy(request).agg(F.percentile_approx("raw", cuts, 10_000).alias("_cuts")))
    above = F.size(F.filter("_cuts", lambda c: c > F.col("raw")))
    first = first.withColumn("_a", F.when(F.col("raw").isNull(), ranges).when(F.col("_cuts").isNull(), 0).otherwise(above)).drop("_cuts")
    keys = [request, "_a"]
    parts = first.groupBy(*keys).agg(F.min("raw").eqNullSafe(F.max("raw")).alias("_tie"), F.percentile_approx("index", cuts, 10_000).alias("_cuts"))
    second = cut(first, keys, parts).withColumn("_b", F.when(F.col("_tie"), F.size(F.filter("_cuts", lambda c: c < F.col("index")))).otherwise(0)).drop("_cuts", "_tie")
    keys = [request, "_a", "_b"]
    before = Window.partitionBy(request).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = second.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("raw"), "index"))
    ranked = cut(second, keys, counts).withColumn("rank", (own + F.col("_before")).cast("int")).select(*scored.columns, "rank")
    return ranked.union(small.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(F.desc("raw"), "index"))))


def aligned_scores(documents: DataFrame, results: DataFrame, request: str, position: str, index: str = "index", raw: str = "raw", order: str | None = None) -> DataFrame:
    """request, position, score: each document's sigmoid score in the input's order; 0 where there is no result, and a
    result without document vanishes. Of results that repeat an index the last by `order` counts, without it the largest."""
    best = F.max(raw) if order is None else F.max_by(raw, order)
    found = results.groupBy(F.col(request).alias("_r"), F.col(index).alias("_i")).agg(best.alias("_raw"))
    joined = documents.join(found, (F.col(request) == F.col("_r")) & (F.col(position) == F.col("_i")), "left")
    return joined.select(request, position, F.coalesce(sigmoid(F.col("_raw")), F.lit(0.0)).alias("score"))


def similarity_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of two small sets of vectors, on the driver."""
    length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(length > 0, (a @ b.T) / np.where(length > 0, length, 1), 0.0)
