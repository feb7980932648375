"""Requests in, responses out: limits, one tokenisation, passes of the model, and arrays in the order of the request's texts.

A request stays one row from end to end, so it needs no key to be put together again: requests that repeat an id stay apart, a request
without texts has empty arrays, and nothing is shuffled. Texts of many requests share passes inside a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from .encode import Encoder, request_encoder, request_scorer
from .limits import DEFAULT_BATCH, DEFAULT_LENGTH, cap, effective_batch, effective_length
from .tokens import TokenizerRegistry, request_counter, routed_counter


def _column(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where there is none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _list(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def refuse_long(requests: DataFrame, column: str, most: int, what: str) -> None:
    """An error that names requests with more than `most` entries, before anything else runs."""
    found = [str(r.request_id) for r in requests.filter(F.size(column) > most).select("request_id").limit(11).collect()]
    if found:
        raise ValueError(f"{what} takes {most} texts of a request at most; too long: {', '.join(found[:10])}{' and more' * (len(found) > 10)}")


def embed_requests(requests: DataFrame, e: Encoder, tokenizer: str | None = None, default_length: int = DEFAULT_LENGTH, default_batch: int = DEFAULT_BATCH, resident: int | None = None) -> DataFrame:
    """A row for each request: request_id, dense, sparse, multi (arrays in the order of the texts), token_count, truncated, max_length,
    token_accounting, dimension, pass_rows (how many rows the pass of each text had).

    requests: request_id, texts and, where they are there, kind, max_length, max_batch. A request's length is clamped to its bounds and,
    for a query, is that of the model that is loaded, if one is; no pass of it has more than max_batch rows. Counts and vectors come
    from one tokenisation, unless another tokenizer is to count. With an unknown count a request has no counts; it has
    vectors all the same. A request without texts measured nothing: empty arrays, a length of 0, no dimension. A dynamically quantised model
    has one pass for each request; requests beyond the model's batch size are refused by name.
    """
    limit = cap(F.coalesce(_column(requests, "kind", "string"), F.lit("doc")), effective_length(F.coalesce(_column(requests, "max_length", "int"), F.lit(0)), default_length), F.lit(resident).cast("int"))
    asked = requests.select("request_id", _list(requests, "texts").alias("texts"), limit.alias("cap"), effective_batch(F.coalesce(_column(requests, "max_batch", "int"), F.lit(0)), default_batch).cast("int").alias("batch"))
    if e.quantization == "dynamic":
        refuse_long(asked, "texts", e.batch_size, "a dynamically quantised model")
        asked = asked.withColumn("batch", F.lit(e.batch_size))
    made = asked.withColumn("e", request_encoder(e)("texts", "cap", "batch"))
    counts = F.col("e.n_tokens") if tokenizer is None else request_counter(tokenizer)("texts")
    made = made.withColumn("n", counts)
    some = F.size("texts") > 0
    known = ~F.exists("n", lambda n: n.isNull())
    return made.select(
        "request_id",
        "e.dense",
        "e.sparse",
        "e.multi",
        F.when(known, F.col("n")).alias("token_count"),
        F.when(known, F.transform("n", lambda n: n > F.col("cap"))).alias("truncated"),
        F.when(some, F.col("cap")).otherwise(0).cast("int").alias("max_length"),
        (some & known).alias("token_accounting"),
        F.when(some, F.array_max(F.transform("e.dense", lambda v: F.when(v.isNotNull(), F.size(v))))).alias("dimension"),
        "e.pass_rows",
    )


def rerank_requests(requests: DataFrame, e: Encoder, default_batch: int = DEFAULT_BATCH) -> DataFrame:
    """request_id, scores: of each document in the request's order, the sigmoid of its first logit, 0 for one without; empty for a
    request without documents. requests: request_id, query, documents and, where it is there, max_batch."""
    batch = effective_batch(F.coalesce(_column(requests, "max_batch", "int"), F.lit(0)), default_batch).cast("int")
    raw = request_scorer(e)(F.col("query"), _list(requests, "documents"), batch)
    made = requests.select("request_id", raw.alias("raw"))
    return made.select("request_id", F.transform("raw", lambda x: F.coalesce(sigmoid(x.cast("double")), F.lit(0.0))).alias("scores"))


def tokenize_requests(requests: DataFrame, registry: TokenizerRegistry, most: int | None = None) -> DataFrame:
    """A row for each request: request_id, tokenizer, token_count, available.

    requests: request_id, texts and, where it is there, tokenizer (none, empty or blank for the registry's default). A name that is not
    registered is refused before anything is counted, with the names that are; so is a request of more than `most` texts, where a most
    is given. A registered tokenizer that cannot be loaded, or one text that it refuses, leaves the whole request unknown: token_count is
    null and available is false. A request without texts has an empty array.
    """
    name = F.coalesce(F.nullif(F.trim(_column(requests, "tokenizer", "string")), F.lit("")), F.lit(registry.default))
    asked = requests.select("request_id", _list(requests, "texts").alias("texts"), name.alias("tokenizer"))
    unknown = asked.filter(~F.col("tokenizer").isin(*registry.paths)).select("tokenizer").distinct().limit(10).collect()
    for r in unknown:
        registry.resolve(r.tokenizer)
    if most is not None:
        refuse_long(asked, "texts", most, "a tokenize request")
    made = asked.withColumn("n", routed_counter({n: registry.paths[n] for n in registry.paths if registry.available(n)})("tokenizer", "texts"))
    known = F.col("n").isNotNull() & ~F.exists("n", lambda n: n.isNull())
    return made.select("request_id", "tokenizer", F.when(known, F.col("n")).alias("token_count"), F.coalesce(known, F.lit(False)).alias("available"))
