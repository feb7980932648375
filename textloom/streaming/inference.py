"""Stateless inference over streams: what works on a batch of rows works on a micro-batch; an addition of this engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_rows(spark: SparkSession, directory: str, schema: StructType, pattern: str | None = None, files_a_batch: int = 64) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(directory)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Processes what is there, in micro-batches, exactly once by the checkpoint, and ends."""
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
