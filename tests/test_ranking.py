"""Blocked top-k against brute force, ranks of a request that holds half of all rows, and encoders that are gated."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import encode as E
from textloom.operators import rank
from textloom.plans import tiny

VECTORS = "id long, vector array<double>"


def brute(queries, corpus, k):
    out = []
    for q, v in queries:
        scored = []
        for i, w in corpus:
            if i is None or v is None or w is None or q is None or not all(x is not None and np.isfinite(x) for x in (*v, *w)):
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((-(round(float(np.dot(v[: len(w)], w[: len(v)]) / n), 9) if n else 0.0), i))
        out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, d=6, seed=0):
    x = np.random.default_rng(seed).integers(-3, 4, (n, d)).astype(float)
    return [(i, r.tolist()) for i, r in enumerate(x)]


@pytest.mark.parametrize("block, sent", [(1 << 20, 1 << 20), (200, 1 << 20), (200, 0), (1 << 20, 0)])
def test_blocks_and_shards(spark, monkeypatch, block, sent):
    monkeypatch.setattr(rank, "BLOCK_BYTES", block)
    monkeypatch.setattr(rank, "BROADCAST_BYTES", sent)
    queries = vectors(30, seed=1) + [(90, None), (91, [float("nan")] * 6), (None, [1.0] * 6), (92, [0.0] * 6), (93, [1.0, 2.0])]
    corpus = vectors(70) + [(100, None), (101, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (102, [0.0] * 6), (None, [1.0] * 6), (103, [1.0, 2.0]), (104, [1.0] * 9)]
    q, c = spark.createDataFrame(queries, VECTORS).repartition(3), spark.createDataFrame(corpus, VECTORS).repartition(5)
    found = rank.top_k(q, c, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Broadcast" in plan) == (sent > 0) and plan.count("corpus") == 0 and "WindowGroupLimit" in plan
    assert rows(found) == brute(queries, corpus, 4)
    if block == 200:
        assert rank.query_blocks(q, "id", "vector")[0].count() > 3


def test_queries_that_repeat_an_id_are_ranked_apart(spark):
    corpus = vectors(20)
    queries = [(1, [1.0] * 6), (1, [1.0] * 6), (1, [-1.0] * 6)]
    found = rows(rank.top_k(spark.createDataFrame(queries, VECTORS), spark.createDataFrame(corpus, VECTORS), 3))
    assert found == brute(queries, corpus, 3) and len(found) == 9


def test_ids_of_strings_and_clashing_names(spark):
    q = spark.createDataFrame([("é", [1.0, 0.0], 1)], "h string, v array<double>, copies int")
    c = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [2.0, 0.0], 2), ("ä", [1.0, 1.0], 3)], "rank string, body array<float>, id int")
    assert [tuple(r) for r in rank.top_k(q, c, 2, "h", "v", "rank", "body").orderBy("rank").collect()] == [("é", "a", 1, 1.0), ("é", "b", 2, 1.0)]


def test_top_k_of_empty_tables(spark):
    some, none = spark.createDataFrame(vectors(3), VECTORS), spark.createDataFrame([], VECTORS)
    for q, c in ((some, none), (none, some), (none, none)):
        assert rank.top_k(q, c, 2).collect() == []
    with pytest.raises(ValueError):
        rank.top_k(some, some, 0)


@pytest.mark.parametrize("ranges", [2, 7, 128])
def test_spread_ranks_are_ranks(spark, ranges):
    rng = np.random.default_rng(4)
    data = [(None if i % 11 == 0 else "hot" if i % 2 else f"r{i % 9}", i % 400 if i % 3 else i, None if i % 13 == 0 else float(rng.choice([0.0, 0.0, 0.0, -0.5, *rng.random(3)])) if i % 17 else float("nan"), f"d{i}") for i in range(2000)]
    df = spark.createDataFrame(data, "request string, index int, raw double, document string")
    df = df.dropDuplicates(["request", "index"])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("raw"), "index")))
    got = rank.rerank(df, "request", "index", F.col("raw"), "document", ranges=ranges)
    key = lambda d: sorted((str(r.request), r.rank, r["index"], str(r.raw), r.document) for r in d.collect())
    assert key(got) == key(want)


def test_no_task_has_all_of_a_hot_request(spark):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 0, id) as request", "cast(id as int) as index", "if(id % 3 = 0, 0.0, id % 997) as raw")
    made = rank.spread_ranks(df, "request", 32)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_a" in plan and "_b" in plan
    hot = made.filter("request = 0").orderBy("rank").collect()
    assert [r.rank for r in hot] == list(range(1, 2001)) and [(-r.raw, r["index"]) for r in hot] == sorted((-r.raw, r["index"]) for r in hot)
    with pytest.raises(ValueError):
        rank.spread_ranks(df, "request", 1)


def test_best_of_a_hot_request(spark):
    pairs = spark.range(3000).selectExpr("if(id % 2 = 0, 'hot', concat('r', id % 50)) as request", "cast(id as int) as pos", "cast(id * 7 % 101 as double) as s")
    found = rank.rerank(pairs, "request", "pos", F.col("s"), n=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Exchange" in plan
    whole = rank.rerank(pairs, "request", "pos", F.col("s")).filter("rank <= 3")
    assert rows(found) == rows(whole)
    with pytest.raises(ValueError):
        rank.rerank(pairs, "request", "pos", F.col("s"), n=0)


def reference(e):
    return tuple(float(x) for x in next(E.encode_rows(e, [e.check_text]))["dense"])


def test_a_wrong_reference_gives_no_rows(spark):
    df = spark.createDataFrame([("the and",), ("of",)], "text string")
    plain = tiny.formula_encoder({"x": 4}, pooling="mean")
    right = E.replace(plain, reference=reference(plain))
    assert [r.encoding for r in E.encode(df, right).collect()] == [r.encoding for r in E.encode(df, plain).collect()]
    wrong = E.replace(plain, reference=tuple(-x for x in right.reference))
    with pytest.raises(Exception, match="does not give its reference vector"):
        E.encode(df, wrong).collect()
    short = E.replace(plain, reference=right.reference[:2])
    with pytest.raises(Exception, match="cosine -1.0"):
        E.encode(df, short).collect()
    with pytest.raises(ValueError):
        tiny.formula_encoder({"x": 4}, head="lexical", reference=(1.0,))


def test_statuses_come_back_as_rows(spark):
    df = spark.createDataFrame([("the and",), (None,)], "text string").coalesce(1)
    plain = tiny.formula_encoder({"x": 4}, pooling="mean")
    right = E.replace(plain, reference=reference(plain))
    cases = {"right": right, "wrong": E.replace(right, reference=tuple(-x for x in right.reference)), "none": plain, "broken": E.replace(right, model=b"x")}
    got = {k: [r.s for r in df.select(E.statuses(e)("text").alias("s")).collect()] for k, e in cases.items()}
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values())
    assert got["right"][0].verified and got["right"][0].attempts == 1 and got["right"][0].error is None
    assert not got["wrong"][0].serving and got["wrong"][0].attempts == 3 and round(got["wrong"][0].cosine, 6) == -1
    assert got["none"][0].cosine is None and "no reference" in got["none"][0].error
    assert got["broken"][0].cosine is None and got["broken"][0].error and not got["broken"][0].serving


def test_a_check_is_made_once_a_worker(monkeypatch):
    e = tiny.formula_encoder({"x": 4}, pooling="mean")
    e = E.replace(e, reference=reference(e))
    E._cache.clear()
    calls, check = [], E.selfcheck.check
    monkeypatch.setattr(E.selfcheck, "check", lambda *a, **k: calls.append(1) or check(*a, **k))
    for _ in range(3):
        list(E.encode_rows(e, ["the", "of"]))
    assert len(calls) == 1 and E.session(e).status.verified


def test_corpus_blocks_are_small(spark):
    """A batch of long vectors is several blocks, and products are worked on in pieces, with the same best ones."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 256))
    df = spark.createDataFrame(pa.table({"id": pa.array(range(len(x)), pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float64()))})).coalesce(1)
    blocks = [len(r.rows) for r in rank.corpus_blocks(df, "id", "vector", 1).collect()]
    assert max(blocks) <= 1.5 * rank.BLOCK_BYTES and sum(blocks) >= x.nbytes
    got = {(r.query_id, r["rank"]): r.id for r in rank.top_k(df.filter("id % 20 = 0"), df, 3).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    best = np.argsort(-(unit[::20] @ unit.T), axis=1)[:, :3]
    assert got == {(20 * q, n + 1): int(i) for q, row in enumerate(best) for n, i in enumerate(row)}
