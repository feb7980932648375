"""The pipeline, stage by stage, against brute force over the tables and planted cases."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, decontaminate, quality, suffix_dedup
from textloom.llm.langid import held_out

from .test_corpus_operators import near

SOURCE = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 of the documents, with copies, a repeated passage, leaks and odd rows beside them."""
    where = str(tmp_path_factory.mktemp("corpus"))
    docs = pq.read_table(f"{SOURCE}/documents.parquet").to_pylist()[:200]
    items = pq.read_table(f"{SOURCE}/benchmark.parquet").to_pylist()
    rng = random.Random(1)
    clean = [d["text"] for d in docs if 600 < len(d["text"]) < 3000]
    extra = [clean[0], clean[0], clean[1].replace(" ", "  ", 3), clean[2] + " tail of it"]
    passage = " ".join(clean[3].split()[:70])
    extra += [f"{' '.join(rng.sample(clean[4].split(), 60))}. {passage} {' '.join(rng.sample(clean[5].split(), 60))}." for _ in range(3)]
    extra += [f"{clean[6][:300]} {items[0]['text']} {clean[7][:300]}", None, "", "x"]
    rows = [tuple(d[c] for c in COLUMNS) for d in docs] + [(1000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return where


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == COLUMNS
            after = texts(out)
        if k == 0:
            model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out(4, 2)))
            assert after == {i: t for i, t in before.items() if model.score(quality.features([(t or "").encode()]))[0] >= 0.7}
            marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            judged = [(i in after) == (marks[i] == 1) for i in before if i in marks]
            assert sum(judged) >= 0.95 * len(judged)
        elif k == 1:
            root = near(list(before.items()), 5, 80, 100)
            assert after == {i: t for i, t in before.items() if root[i][1] == i} and not {1000, 1001, 1002} & set(after)
        elif k == 2:
            expected = suffix_dedup.brute_force(list(before.items()))
            assert set(after) == set(before)
            for i, t in before.items():
                gone = expected[i][1]
                assert (after[i] == t) == (gone == 0) or not t
                assert len((t or "").encode()) - gone - len((after[i] or "").encode()) in range(13)
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            found = decontaminate.brute_force(list(before.items()), items)
            assert after == {i: t for i, t in before.items() if not found[i][4]}
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(bpe.tokenizer_file())
            assert {r.doc_id: r.ids for r in out.collect()} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in before.items()}
        docs = out
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20).withColumns({"score": F.lit("x"), "n_words": F.lit(1), "kept": F.lit(2), "ids": F.lit(3), "n_tokens": F.lit("t"), "bits": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder).columns == docs.columns
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and last.count() == 20


def test_odd_rows_of_each_stage(spark, folder):
    """Nulls in every column, empty and very long texts, and ids that repeat, through every stage but the first as they are."""
    clean = next(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text and 900 < len(r.text) < 2500)
    long = " ".join(f"w{i} v{i % 977}" for i in range(150_000))
    rows = [(1, clean, "en", "a", 1), (1, clean, "en", "b", 1), (1, "another text that is under the same id and has words", "en", "c", 1), (2, clean, None, None, None), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, "words under no id at all are here", "en", "a", 1), (5, long, "en", "a", 9), (6, long + " and more", "en", "a", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema)
    found = {name: stage(spark, docs, folder).collect() for name, stage in corpus_pipeline.STAGES}
    assert len(found["quality classifier"]) <= len(rows)
    near = sorted((r.doc_id or 0, (r.text or "")[:7]) for r in found["n-gram Jaccard join"])
    assert [i for i, _ in near] == [0, 1, 3, 3, 4, 5]
    cut = found["suffix-array dedup"]
    assert len(cut) == len(rows) and sum(r.text is None for r in cut) == 2 and {r.doc_id: len(r.text or "") for r in cut}[6] < 200
    assert len(found["benchmark decontamination"]) == len(rows)
    ids = found["BPE encoding and decoding"]
    assert len(ids) == len(rows) and sum(r.n_tokens == 0 for r in ids) == 3 and all(len(r.ids) == r.n_tokens for r in ids)
