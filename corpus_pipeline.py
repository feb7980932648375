"""From raw documents to token ids: five operators of textloom.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`; the last returns the ids and digests of each document.

Defined cases: a null or empty text is judged by the classifier like any other; one that it keeps has no shingles, no repeated
bytes, no leaks and no tokens, so it goes through to the end (a null text stays null until then). Of rows that repeat a
doc_id and have shingles, the near-copy stage keeps one, as copies; rows of the other stages are judged each. Ties of ids
are the operators' (the smaller id stays). Texts of any length are worked on whole. An empty table gives no rows; extra
columns, whatever their names, go through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, common, decontaminate, ngram_join, quality, suffix_dedup
from textloom.llm.langid import held_out

#: Bytes of text that a task of a stage works on at once: less than the operators' own, as the executors' memory holds on to what
#: earlier stages used.
BLOCK = 6 << 20
#: The stages end in ids, which SQL cannot make; tests hold the pipeline against its parts by brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Labels of a fold are not learned from, so that it can be tested."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_quality(docs, quality.fit(docs, labels.filter(~held_out(4, 2))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity from 0.8 on."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100, block_bytes=BLOCK)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that also start earlier go; n_chars follows the text."""
    left = suffix_dedup.remove_repeats(docs, block_bytes=BLOCK)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="drop")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), ids=True, block_bytes=BLOCK)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
