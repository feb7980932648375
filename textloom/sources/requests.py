"""Requests and responses as JSON, with the position of each text as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of each kind of request.
EMBED = "request_id string, texts array<string>, kind string, max_length int, max_batch int"
RERANK = "request_id string, query string, documents array<string>, max_length int, max_batch int"
TOKENIZE = "request_id string, texts array<string>, tokenizer string"


def read_requests(spark: SparkSession, path: str, schema: str = EMBED) -> DataFrame:
    """One request a line; fields that are missing are null, and 0 for limits."""
    df = spark.read.schema(schema).json(path)
    return df.fillna(0, [c for c in ("max_length", "max_batch") if c in df.columns])


def texts_of(requests: DataFrame, column: str = "texts") -> DataFrame:
    """A row for each text, with its position; a request without texts has none."""
    return requests.select(*[c for c in requests.columns if c != column], F.posexplode(column).alias("pos", "text"))


def responses(rows: DataFrame, request: str, position: str, columns: dict[str, str]) -> DataFrame:
    """For each request, its columns as arrays in order of position: {name of the array: column}."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), *[F.col(c).alias(n) for n, c in columns.items()])))
    out = rows.groupBy(request).agg(packed.alias("_rows"))
    return out.select(request, *[F.col(f"_rows.{n}").alias(n) for n in columns])


def write_responses(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
