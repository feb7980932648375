"""What the training-data operators share: durable intermediate tables, Arrow plumbing and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, ship, small_batches

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or, where that is unset in local mode (tests), a temporary one. On a
    cluster no folder of the driver's will do, and an unset one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made.add(path)
    return path


def prepare(spark: SparkSession, most: int = 8 << 20) -> None:
    """Send this package to the workers, and let Arrow batches of this session hold `most` bytes at most: long texts would else fill the executors' memory beyond
    the heap, where each task has several batches at once. A smaller setting stays."""
    ship(spark)
    small_batches(spark, most)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _made.discard(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `written` gave; no plan that is still to run may read them. Shuffle files of finished jobs go, too:
    Spark removes them when the driver's JVM collects what refers to them, which may else be half an hour later. It holds on
    to the last job until another one runs."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = file.rsplit("/", 1)[0]
            for made in [m for m in _made if path.endswith(re.sub(r"^\w+:/*", "/", m))]:
                drop_path(spark, made)
    spark.range(1).count()
    spark._jvm.System.gc()


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_made):
        try:
            if spark is not None:
                drop_path(spark, path)
        except Exception:  # the session is already going down; the files are then the cluster's to clear
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings in `column` hold about `most` bytes (a longer single row stands alone)."""
    col = batch.column(column)
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0.0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def block_tables(kept: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, pa.Table]]]:
    """Runs of batches as (block number, table); strings are in column `kept`. Numbers follow the partition and the order in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            for batch in sliced(whole, kept, block_bytes // 4):
                held.append(batch)
                size += batch.nbytes
                if size >= block_bytes:
                    yield (part << 24) + n, pa.Table.from_batches(held)
                    n, held, size = n + 1, [], 0
                    release()
        if held:
            yield (part << 24) + n, pa.Table.from_batches(held)
            held = []
        release()

    return run


def block_bodies(df: DataFrame, kept: int, block_bytes: int) -> DataFrame:
    """The blocks themselves: block, body (the compressed table)."""
    blocks = block_tables(kept, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["block", "body"])

    return df.mapInArrow(run, "block bigint, body binary")


def in_blocks(bodies: DataFrame, told: DataFrame, parts: int):
    """Bodies and what is told about them, cogrouped by block in `parts` tasks: a number that follows the input's size, so that
    a task holds a few blocks whatever spark.sql.shuffle.partitions is."""
    n = max(parts, int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bodies.repartition(n, "block").groupBy("block").cogroup(told.repartition(n, "block").groupBy("block"))


def body_table(bodies: pa.Table) -> pa.Table:
    if bodies.num_rows != 1:
        raise RuntimeError("the documents changed between two passes; write them as a table first")
    return pa.ipc.open_stream(zstandard.decompress(bodies.column("body")[0].as_py())).read_all()


def column_bytes(table: pa.Table, column: int) -> list[bytes]:
    return [t for c in table.column(column).chunks for t in bytes_list(c)]


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers with bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def from_planes(b: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def replayable(df: DataFrame) -> bool:
    """Whether the plan is only projections and filters over files: run again, it gives the same rows in the same order."""
    nodes = re.findall(r"^[ :+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return set(nodes) <= {"Project", "Filter", "Relation"}


def bytes_list(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (u, v) of a task: an edge from each node to the least one that these edges reach."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    names = table.schema.names
    u, v = (c.to_numpy() for c in table.columns)
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names)
    release()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, task_edges: int = 1 << 20) -> DataFrame:
    """Columns `node`, `root`: the smallest node reachable from each node of the undirected edges.

    Where nodes are whole numbers, each task first replaces its own edges, `task_edges` at most on average, by stars: no more than one edge a
    node, with the same reachability. If one task is enough for all edges, these are the components. Beyond that follow
    alternating large-star and small-star steps (Kiveris et al., 2014): every step keeps the reachability and the number
    of edges bounded by the input's, so a component of any size takes a logarithmic number of rounds and no component is
    ever gathered in one task. A hub's neighbours are reached by an aggregate and a join, both of which Spark can
    combine or split. Null ends and self-loops are ignored; an empty input gives an empty result.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    cur = written(cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    kind = cur.schema["u"].dataType.simpleString()
    if kind in ("bigint", "int"):
        tasks = max(1, -(-cur.count() // task_edges))
        before, cur = cur, written(cur.coalesce(tasks).mapInArrow(_stars, f"u {kind}, v {kind}"), "edges")
        drop(cur.sparkSession, before)
        if tasks == 1:
            stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
    last = None
    for _ in range(rounds):
        stats = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stats == last or not stats[0]:
            break
        last = stats
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u points to u's least
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of u, and u, point to u's least smaller neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        before, cur = cur, written(small, "edges")
        drop(cur.sparkSession, before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    spark = cur.sparkSession
    if last is None or not last[0]:
        kind = cur.schema["u"].dataType
        return spark.createDataFrame([], cur.schema).select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root"))
    stars = cur.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
