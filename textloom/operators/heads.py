"""Learned-sparse heads in relational form: token rows in, one sparse vector a document out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import SPECIAL_IDS

SPARSE = "struct<indices array<bigint>, values array<float>>"


def max_per_id(tokens: DataFrame, key: str, token_id: str, weight: str, mask: str | None = None, special: tuple[int, ...] = SPECIAL_IDS) -> DataFrame:
    """key, token_id, weight: the largest weight of each id in a document; special, masked and non-positive ones drop."""
    rows = tokens.filter(~F.col(token_id).isin(*special) & (F.col(weight) > 0))
    if mask is not None:
        rows = rows.filter(F.col(mask) == 1)
    return rows.groupBy(key, token_id).agg(F.max(weight).alias(weight))


def sparse(entries: DataFrame, key: str, token_id: str, weight: str) -> DataFrame:
    """key, sparse: indices ascending and their values."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(token_id).cast("bigint").alias("i"), F.col(weight).cast("float").alias("w"))))
    return entries.groupBy(key).agg(pairs.alias("_p")).select(key, as_sparse(F.col("_p")).alias("sparse"))


def as_sparse(pairs: Column) -> Column:
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["w"]).alias("values"))


def lexical_head(tokens: DataFrame, key: str, token_id: str, projection: str, mask: str | None = None) -> DataFrame:
    """As max_per_id, from projections before relu."""
    return max_per_id(tokens.withColumn("weight", F.greatest(F.col(projection), F.lit(0.0))), key, token_id, "weight", mask)


def splade_head(logits: DataFrame, key: str, vocabulary_id: str, logit: str, mask: str | None = None) -> DataFrame:
    """key, vocabulary_id, weight: the largest ln(1 + relu(logit)) over positions, where positive."""
    rows = logits if mask is None else logits.filter(F.col(mask) == 1)
    return rows.groupBy(key, vocabulary_id).agg(F.max(F.log1p(F.greatest(F.col(logit).cast("double"), F.lit(0.0)))).alias("weight")).filter("weight > 0")
