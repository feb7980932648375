"""Passes by length, and requests that stay what they are."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import batching, serve, tokens
from textloom.operators import encode as E
from textloom.operators.layout import attention_bytes
from textloom.plans import tiny


@given(st.lists(st.integers(0, 9000), max_size=300), st.integers(1, 70), st.integers(1, 9000), st.booleans(), st.booleans())
@settings(max_examples=200, deadline=None)
def test_passes(lengths, batch_size, cap, fixed, filled):
    lengths = [min(n, cap) for n in lengths]
    budget = 1 << 26
    found = batching.passes(lengths, cap, batch_size, budget, fixed, filled)
    assert sorted(i for p in found for i in p.at) == list(range(len(lengths)))
    steps = [cap] if fixed else batching.ladder(cap, max(lengths, default=1))
    for p in found:
        assert p.length in steps and all(lengths[i] <= p.length for i in p.at)
        assert 1 <= len(p.at) <= p.rows <= batch_size and (p.rows == 1 or attention_bytes(p.rows, p.length) <= budget)
        assert list(p.at) == sorted(p.at)
        if not fixed:
            assert all(p.length == steps[0] or 3 * lengths[i] > 2 * p.length for i in p.at)
    if filled:
        assert len({(p.rows, p.length) for p in found}) <= len(steps)


def test_ladder():
    assert batching.ladder(100) == [16, 24, 32, 48, 64, 96, 100] and batching.ladder(8) == [8] and batching.ladder(1 << 40, 33) == [16, 24, 32, 48]
    assert batching.rows_of(8192, 64) == 1 and batching.rows_of(256, 64) == 64 and batching.rows_of(1024, 64, 1 << 29) == 4
    with pytest.raises(ValueError):
        batching.ladder(0)
    with pytest.raises(ValueError):
        batching.passes([1], 8, 0)


def test_plan_as_columns(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 16, 17, 33, 90, 97, 100, 4000)] + [(None,)], "n int")
    got = df.select("n", batching.padded_length(F.col("n"), 100).alias("length")).select("*", batching.pass_rows(F.col("length"), 64, 1 << 24).alias("rows")).collect()
    steps = batching.ladder(100)
    for r in got:
        want = None if r.n is None else next(s for s in steps if s >= min(r.n, 100))
        assert r.length == want and (want is None or r.rows == batching.rows_of(want, 64, 1 << 24))


def test_few_shapes_and_little_padding(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(tiny.WORDS, n)) for n in rng.zipf(1.3, 400).clip(1, 3000)]
    shapes, forward = [], E.forward

    def watched(*args, **kwargs):
        out = forward(*args, **kwargs)
        shapes.append(out[1].shape)
        return out

    monkeypatch.setattr(E, "forward", watched)
    plain = E.encode_rows(tiny.formula_encoder({"x": 4}, batch_size=8, pooling="mean"), texts)
    plain = list(plain)
    total, padded = sum(len(t.split()) for t in texts), sum(a * b for a, b in shapes)
    assert padded < 1.5 * total + 16 * len(texts)
    together = sum(8 * max(len(t.split()) for t in texts[i : i + 8]) for i in range(0, len(texts), 8))
    assert padded < together / 2
    shapes.clear()
    pinned = list(E.encode_rows(tiny.formula_encoder({"x": 4}, batch_size=8, pooling="mean", pin=True), texts))
    assert len(set(shapes)) == len({b for _, b in shapes}) <= len(batching.ladder(3000))
    shapes.clear()
    one = list(E.encode_rows(tiny.formula_encoder({"x": 4}, batch_size=8, max_length=3000, pooling="mean", pin=True, fixed_shape=True, attention_budget=1 << 50), texts))
    assert set(shapes) == {(8, 3000)}
    for other in (pinned, one):
        assert all(np.allclose(a["dense"], b["dense"], atol=1e-6) for a, b in zip(plain, other))


def templated():
    return tiny.template_tokenizer(tiny.WORDS)


def test_one_tokenisation_gives_counts_and_cut_ids():
    from tokenizers import Tokenizer

    e = E.Encoder(model=tiny.gather_model({"x": np.zeros((40, 2))}), tokenizer=templated(), max_length=9)
    texts = ["the and that", "", "of " * 30, "zz", "with be is for in to de", "with be is for in to de la"] * 60
    plain, cut = Tokenizer.from_str(templated()), Tokenizer.from_str(templated())
    for caps in (None, [3 + i % 5 for i in range(len(texts))]):
        got = E.tokenise(e, texts, caps)
        assert got.counts == [len(plain.encode(t).ids) for t in texts]
        for i, t in enumerate(texts):
            cut.enable_truncation(9 if caps is None else caps[i])
            assert got.ids[i].tolist() == cut.encode(t).ids
    pairs = E.tokenise(e, ["the and", "of " * 20], None, ["that of with", "the"])
    cut.enable_truncation(9)
    assert [x.tolist() for x in pairs.ids] == [cut.encode("the and", "that of with").ids, cut.encode("of " * 20, "the").ids] and pairs.counts == [8, 24]


REQUESTS = "request_id string, texts array<string>, kind string, max_length int, max_batch int"


def test_requests_keep_identity(spark):
    rows = [("a", ["the", "and of"], "doc", 0, 0), ("a", ["the", "and of"], "doc", 0, 0), ("a", ["with"], "doc", 0, 0), ("b", [], "doc", 20, 0), ("c", None, None, None, None), (None, ["of"], "doc", 5, 1), ("d", ["x", None, "the"], "doc", 0, 2)]
    got = serve.embed_requests(spark.createDataFrame(rows, REQUESTS), tiny.formula_encoder({"x": 4}, pooling="mean")).collect()
    assert Counter((r.request_id, len(r.dense)) for r in got) == Counter([("a", 2), ("a", 2), ("a", 1), ("b", 0), ("c", 0), (None, 1), ("d", 3)])
    by = {(r.request_id, len(r.dense)): r for r in got}
    for key in (("b", 0), ("c", 0)):
        r = by[key]
        assert (r.dense, r.sparse, r.multi, r.token_count, r.truncated, r.max_length, r.token_accounting, r.dimension) == ([], [], [], [], [], 0, False, None)
    assert by["a", 2].token_count == [1, 2] and by["a", 2].dimension == 4 and by[None, 1].max_length == 16
    d = by["d", 3]
    assert d.token_count is None and d.truncated is None and not d.token_accounting and d.dense[1] is None and d.dense[2] is not None and d.dimension == 4
    alone = E.encode(spark.createDataFrame([("and of",)], "text string"), tiny.formula_encoder({"x": 4}, pooling="mean")).first().encoding.dense
    assert by["a", 2].dense[1] == alone
    assert serve.embed_requests(spark.createDataFrame([], REQUESTS), tiny.formula_encoder({"x": 4})).collect() == []


def test_requests_without_optional_columns(spark):
    got = serve.embed_requests(spark.createDataFrame([(1, ["the"], "x")], "request_id long, texts array<string>, dense string"), tiny.formula_encoder({"x": 4})).first()
    assert got.max_length == 256 and got.request_id == 1


def test_largest_batch_is_kept(spark):
    rows = [("a", ["the"] * 10, "doc", 0, 3), ("b", ["of"] * 10, "doc", 0, 3), ("c", ["of"] * 70, "doc", 0, 0)]
    got = {r.request_id: r.pass_rows for r in serve.embed_requests(spark.createDataFrame(rows, REQUESTS).coalesce(1), tiny.formula_encoder({"x": 4})).collect()}
    assert max(got["a"] + got["b"]) <= 3 and max(got["c"]) == 64


def test_texts_are_tokenised_once(monkeypatch):
    calls, raw = [], E._raw
    monkeypatch.setattr(E, "_raw", lambda tokenizer, texts: calls.extend(texts) or raw(tokenizer, texts))
    import pyarrow as pa

    e = tiny.formula_encoder({"x": 4}, pooling="mean")
    out = next(E.request_encoder(e).func(iter([(pa.array([["the", "of"], ["and"]]), pa.array([16, 2]), pa.array([4, 4]))])))
    assert sorted(calls) == ["and", "of", "the"] and out.field("n_tokens").to_pylist() == [[1, 1], [1]]


def test_refused_texts_are_unknown(monkeypatch):
    e = tiny.formula_encoder({"x": 4}, pooling="mean")
    raw = E._raw

    def refusing(tokenizer, texts):
        return [None if t == "bad" else x for t, x in zip(texts, raw(tokenizer, texts))]

    monkeypatch.setattr(E, "_raw", refusing)
    found = E.encode_tokens(e, E.tokenise(e, ["the", "bad", "of"]))
    assert found[1] is None and found[0]["dense"] is not None and E.tokenise(e, ["the", "bad"]).counts == [1, None]


def test_a_dynamic_request_is_one_pass(spark):
    e = tiny.formula_encoder({"x": 4}, batch_size=5, pooling="mean", quantization="dynamic")
    rows = [("a", ["the"] * 5, "doc", 0, 1), ("b", ["of " * 40, "of"], "doc", 0, 0), ("c", [], "doc", 0, 0)]
    got = {r.request_id: r.pass_rows for r in serve.embed_requests(spark.createDataFrame(rows, REQUESTS).coalesce(1), e).collect()}
    assert got == {"a": [5] * 5, "b": [2, 2], "c": []}
    with pytest.raises(ValueError, match="long one"):
        serve.embed_requests(spark.createDataFrame([("long one", ["x"] * 6, "doc", 0, 0)], REQUESTS), e)


def test_rerank_requests_keep_identity(spark):
    rows = [("r", "the", ["and", None, "of zz"]), ("r", "the", ["and"]), ("s", None, ["and"]), ("t", "of", []), ("u", "of", None)]
    got = serve.rerank_requests(spark.createDataFrame(rows, "request_id string, query string, documents array<string>"), tiny.scoring_encoder()).collect()
    w = tiny.scoring_table()[:, 0]
    p = lambda *ids: 1 / (1 + np.exp(-sum(w[i] for i in ids)))
    assert sorted((r.request_id, [round(x, 6) for x in r.scores]) for r in got) == sorted([("r", [round(p(1, 2), 6), 0.0, round(p(1, 4), 6)]), ("r", [round(p(1, 2), 6)]), ("s", [0.0]), ("t", []), ("u", [])])


TOKENIZE = "request_id string, texts array<string>, tokenizer string"


def test_tokenize_requests(spark, tmp_path):
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    registry = tokens.TokenizerRegistry({"words": tiny.tiny_tokenizer(tiny.WORDS), "spaces": tiny.space_tokenizer(), "absent": None, "broken": str(broken)}, default="words")
    assert registry.status["absent"] == "absent" and registry.status["broken"].startswith("unreadable")
    texts = ["it's a b", "", "c  d"]
    rows = [("a", texts, None), ("a", texts, " "), ("b", texts, "spaces"), ("c", texts, "absent"), ("d", ["x", None], "words"), ("e", [], "spaces"), ("f", None, "absent"), ("g", ["x"], "broken")]
    df = spark.createDataFrame(rows, TOKENIZE)
    got = sorted((tuple(r) for r in serve.tokenize_requests(df, registry).collect()), key=str)
    words, spaces = [5, 0, 2], [3, 0, 2]
    assert got == sorted([("a", "words", words, True), ("a", "words", words, True), ("b", "spaces", spaces, True), ("c", "absent", None, False), ("d", "words", None, False), ("e", "spaces", [], True), ("f", "absent", None, False), ("g", "broken", None, False)], key=str)
    with pytest.raises(ValueError, match="absent, broken, spaces, words"):
        serve.tokenize_requests(df.union(spark.createDataFrame([("h", ["x"], "other")], TOKENIZE)), registry)
    with pytest.raises(ValueError, match="a, a, b, c"):
        serve.tokenize_requests(df.filter("request_id < 'd'").coalesce(1), registry, most=2)
    assert serve.tokenize_requests(df.drop("tokenizer"), registry, most=3).filter("available").count() == 7


def test_requests_are_not_shuffled(spark):
    df = spark.createDataFrame([("a", ["x"], "doc", 0, 0)], REQUESTS)
    plan = serve.embed_requests(df, tiny.formula_encoder({"x": 4}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython [run") <= 1


@pytest.mark.parametrize("kind", ["texts", "requests", "spans"])
def test_a_worker_holds_part_of_a_batch(spark, kind, monkeypatch):
    """However many rows Arrow sends at once, only so many are tokens and vectors at a time; a long row stands alone."""
    from textloom.operators import batching, encode, tokens
    from textloom.plans import tiny

    texts = [f"the cat {i} " * (1 + i % 5) for i in range(2500)] + [None, "the " * 400_000, "", "a cat"]
    model = tiny.formula_encoder({"pooled_a": 8, "b": 1, "c": 4}, head="joint", quantization="dynamic" if kind == "requests" else "none", batch_size=4, max_length=64)
    seen, load = [], tokens._tokenizer

    class Counted:
        def __init__(self, path):
            self.inner = load(path)

        def encode_batch(self, rows):
            seen.append(list(rows))
            return self.inner.encode_batch(rows)

    tokenise = encode.tokenise
    monkeypatch.setattr(encode, "tokenise", lambda e, part, *more: seen.append(list(part)) or tokenise(e, part, *more))
    monkeypatch.setattr(tokens, "_tokenizer", Counted)
    if kind == "texts":
        found = [r for b in encode.encoder(model).func(iter([pa.array(texts)])) for r in b.to_pylist()]
        whole = [r for t in texts[:3] + texts[-4:] for b in encode.encoder(model).func(iter([pa.array([t], pa.string())])) for r in b.to_pylist()]
        assert found[:3] + found[-4:] == whole
    elif kind == "requests":
        rows = [texts[i : i + 2] for i in range(0, len(texts), 2)] * 2
        found = [r for b in encode.request_encoder(model).func(iter([(pa.array(rows), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int32()))])) for r in b.to_pylist()]
        assert [len(r["n_tokens"]) for r in found] == [2] * len(rows)
    else:
        found = [r for b in tokens.span_finder(tiny.tiny_tokenizer(tiny.WORDS), 0).func(iter([pa.array(texts)])) for r in b.to_pylist()]
        assert len(found) == len(texts) and found[2500] is None and found[2501] == []
    parts = [p for p in seen if sum(len(t or "") for t in p) < 1_000_000]
    assert len(parts) >= 3 and max(len(p) for p in seen) <= 2 * batching.PART_ROWS
