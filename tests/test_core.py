"""The core engine: expressions against numpy, contracts of limits, tokens, heads, ranking, layout and encoding."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import encode as E
from textloom.operators import heads, images, layout, limits, models, rank, selfcheck, tokens
from textloom.plans import tiny
from textloom.sources import images as image_files
from textloom.sources import requests, tokenizer_files
from textloom.sources import vectors as vector_files


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_dot_and_cosines_at_their_edges(spark):
    rows = [([1.0, 2.0], [3.0, 4.0]), ([1.0, 2.0, 9.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.strict_cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == 11 and got[1][0] == 11
    assert got[0][1] == pytest.approx(11 / (5**0.5 * 5)) == got[0][2]
    assert got[1][2] == -1 and got[2][1] == 0 and got[2][2] == -1 and got[3][1] == 0 and got[3][2] == -1


def test_normalisations(spark):
    r = one(spark, "v array<float>, z array<float>", ([3.0, 4.0], [0.0, 0.0]), V.l2_normalize(F.col("v")), V.l2_normalize_inner(F.col("v")), V.l2_normalize(F.col("z")), V.l2_normalize_inner(F.col("z")))
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == pytest.approx([0.6, 0.8]) and r[2] == [0, 0] and r[3] == [0, 0]
    assert np.allclose(A.l2_normalize(np.array([[3.0, 4.0], [0, 0]])), [[0.6, 0.8], [0, 0]])


def test_pooling_agrees_with_arrays(spark):
    h = np.random.default_rng(0).standard_normal((3, 4, 2))
    masks = np.array([[1, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]])
    df = spark.createDataFrame([(i, h[i].tolist(), masks[i].tolist()) for i in range(3)], "i int, h array<array<double>>, m array<int>")
    rows = df.orderBy("i").select(V.mean_pool(F.col("h"), F.col("m")), V.mean_pool_clamped(F.col("h"), F.col("m")), V.last_token_pool(F.col("h"), F.col("m")), V.cls_pool(F.col("h")), V.multivector_keep(F.col("h"), F.col("m"))).collect()
    for i, r in enumerate(rows):
        assert np.allclose(r[0], A.mean_pool(h, masks)[i])
        assert np.allclose(r[1], A.mean_pool_clamped(h, masks)[i])
        assert np.allclose(r[2], A.last_token_pool(h, masks)[i])
        assert np.allclose(r[3], A.cls_pool(h, masks)[i])
        assert np.allclose(np.array(r[4]).reshape(-1, 2), h[i][:3][masks[i][1:] == 1])
    assert np.allclose(A.last_position_pool(h, masks), h[:, -1])
    with pytest.raises(ValueError):
        A.cls_pool(np.zeros(3), masks)


def test_output_guard():
    assert A.covers(np.zeros((3, 5, 2)), 2, 4).shape == (2, 4, 2)
    for shape in ((1, 4, 2), (2, 3, 2), (2, 4)):
        with pytest.raises(ValueError):
            A.covers(np.zeros(shape), 2, 4)


def test_sigmoid_extremes(spark):
    r = one(spark, "x double", (0.0,), V.sigmoid(F.col("x")), V.sigmoid(F.lit(-800.0)), V.sigmoid(F.lit(800.0)))
    assert tuple(r) == (0.5, 0.0, 1.0)
    assert A.sigmoid(np.array([0.0, -800, 800])).tolist() == [0.5, 0, 1]


def test_limits():
    assert limits.effective() == limits.Limits(256, 64)
    assert limits.effective(1, 1).max_length == 16 and limits.effective(99999, 0).max_length == 8192
    assert [limits.cap_for(*x) for x in (("query", 128, 512), ("query", 128, None), ("doc", 128, 512), (None, 128, 512))] == [512, 128, 128, 128]
    assert limits.one_of(None, "a", ["a", "b"]) == "a"
    with pytest.raises(ValueError, match="a, b"):
        limits.one_of("c", "a", ["b", "a"])


def test_refusal_of_too_many_rows(spark):
    assert limits.refuse_beyond(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        limits.refuse_beyond(spark.range(4), 3)


def test_token_counts_know_unknown(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(tiny.tiny_tokenizer(["hello", "world"]))
    registry = tokens.TokenizerRegistry({"base": str(path), "gone": str(tmp_path / "no.json"), "none": None}, "base")
    assert registry.status == {"base": "available", "gone": "absent", "none": "absent"} and registry.resolve(None) == "base"
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert tokens.TokenizerRegistry({"x": str(broken)}, "x").status["x"].startswith("unreadable")
    df = spark.createDataFrame([(1, 0, "Hello world"), (1, 1, "one two three"), (2, 0, None), (2, 1, "hello")], "req int, pos int, text string")
    counted = tokens.with_counts(df, "text", str(path), 2)
    assert {(r.req, r.pos): (r.n_tokens, r.truncated) for r in counted.collect()} == {(1, 0): (2, False), (1, 1): (3, True), (2, 0): (None, None), (2, 1): (1, False)}
    used = {r.req: (r.token_count, r.truncated, r.max_length, r.token_accounting) for r in tokens.usage(counted, "req", "pos", 2).collect()}
    assert used == {1: ([2, 3], [False, True], 2, True), 2: (None, None, 2, False)}
    assert counted.agg(tokens.truncated_count(F.col("n_tokens"), 2)).first()[0] == 1
    assert {r.n_tokens for r in tokens.with_counts(df, "text", None).collect()} == {None}


def test_tokenizer_directory(tmp_path):
    (tmp_path / "tokenizer.json").write_text(tiny.tiny_tokenizer(["a", "[PAD]"]))
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "special_tokens_map.json").write_text(json.dumps({"cls_token": "[CLS]", "sep_token": {"content": "[SEP]"}}))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"model_max_length": 3, "pad_token": "[PAD]"}))
    tok = tokenizer_files.load_tokenizer(str(tmp_path), 2)
    assert [len(e.ids) for e in tok.encode_batch(["a a a a", "a"])] == [2, 2]
    assert tok.token_to_id("[CLS]") is not None and tok.token_to_id("[SEP]") is not None
    for missing in ("model_max_length", "pad_token"):
        full = {"model_max_length": 3, "pad_token": "[PAD]"}
        full.pop(missing)
        (tmp_path / "tokenizer_config.json").write_text(json.dumps(full))
        with pytest.raises(ValueError, match=missing):
            tokenizer_files.load_tokenizer(str(tmp_path))


def test_words_and_templates(spark):
    r = one(spark, "t string", ("Où est-ce? <img> x",), T.words(F.col("t")), T.word_count(F.lit(None).cast("string")), T.fill_template("q: {text}!", F.col("t")), T.expand_placeholder(F.col("t"), "<img>", F.lit(2)))
    assert r[0] == ["Où", "est", "-", "ce", "?", "<", "img", ">", "x"] and r[1] is None and r[2] == "q: Où est-ce? <img> x!" and r[3] == "Où est-ce? <img><img> x"
    with pytest.raises(ValueError):
        T.fill_template("none", F.col("t"))
    with pytest.raises(Exception, match="expected one"):
        one(spark, "t string", ("no slot",), T.expand_placeholder(F.col("t"), "<img>", F.lit(2)))
    r = one(spark, "t string, n string", ("a <img> b <img>", None), T.expand_placeholder(F.col("t"), "<img>", F.lit(0)), T.expand_placeholder(F.col("t"), "<img>", F.lit(3)), T.expand_placeholder(F.col("n"), "<img>", F.lit(3)))
    assert tuple(r) == ("a <img> b <img>", "a <img><img><img> b <img>", None)
    assert A.spans(np.array([5, 5, 1, 5]), 5) == [(0, 2), (3, 4)] and A.spans(np.array([]), 5) == []


def test_heads_agree(spark):
    rng = np.random.default_rng(1)
    h, ids, mask = rng.standard_normal((2, 6, 3)), np.array([[1, 7, 7, 9, 4, 2], [8, 8, 8, 5, 5, 0]]), np.array([[1, 1, 1, 1, 0, 1], [1, 1, 1, 1, 1, 1]])
    w, b = np.array([0.5, -1, 2.0]), 0.1
    expected = A.lexical_head(h, ids, mask, w, b)
    rows = [(i, int(ids[i, j]), float(h[i, j] @ w + b), int(mask[i, j])) for i in range(2) for j in range(6)]
    df = spark.createDataFrame(rows, "d int, t long, p double, m int")
    got = {r.d: r.sparse for r in heads.sparse(heads.lexical_head(df, "d", "t", "p", "m"), "d", "t", "weight").collect()}
    for i, (found, values) in enumerate(expected):
        if len(found):
            assert got[i]["indices"] == found.tolist() and np.allclose(got[i]["values"], values, atol=1e-6)
        else:
            assert i not in got
    logits = rng.standard_normal((1, 4, 5))
    found, values = A.splade_head(logits, np.array([[1, 1, 0, 1]]))[0]
    rows = [(0, k, float(logits[0, j, k]), int(j != 2)) for j in range(4) for k in range(5)]
    got = heads.splade_head(spark.createDataFrame(rows, "d int, v int, x double, m int"), "d", "v", "x", "m").orderBy("v").collect()
    assert [r.v for r in got] == found.tolist() and np.allclose([r.weight for r in got], values, atol=1e-6)


def test_top_k_ties_zero_vectors_and_slices(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<float>")
    queries = corpus.filter("id in (1, 3)")
    got = [tuple(r) for r in rank.top_k(queries, corpus, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0), (3, 3, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 3, 0.0)]
    monkeypatch.setattr(rank, "BLOCK_BYTES", 16)
    assert [tuple(r) for r in rank.top_k(queries, corpus, 3).orderBy("query_id", "rank").collect()] == got
    assert rank.top_k(queries, corpus, 99).count() == 8  # the vector that is null is no result
    odd = corpus.union(spark.createDataFrame([(6, [-1.0, 0.1]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, None]), (None, [1.0, 0.0]), (10, [1.0])], corpus.schema))
    for ask in (rank.top_k, rank.top_k_native):
        found = [(r.id, round(r.score, 3)) for r in ask(odd.filter("id = 1"), odd, 99).orderBy("rank").collect()]
        assert found == [(1, 1.0), (2, 1.0), (10, 1.0), (3, 0.0), (4, 0.0), (6, -0.995)]
        assert ask(odd.filter("id = 7"), odd, 3).count() == 0
    native = rank.top_k_native(queries.filter("id = 1"), corpus.filter("vector is not null"), 2)
    assert [tuple(r) for r in native.orderBy("rank").collect()] == [(1, 1, 1, 1.0), (1, 2, 2, 1.0)]
    assert rank.top_k(queries.limit(0), corpus, 3).count() == 0
    assert rank.similarity_matrix(np.eye(2), np.array([[2.0, 0], [0, 0]])).tolist() == [[1, 0], [0, 0]]


def test_rerank_and_alignment(spark):
    docs = spark.createDataFrame([("r", i, f"d{i}") for i in range(3)], "req string, pos int, doc string")
    raw = F.when(F.col("pos") == 1, 2.0).otherwise(-1.0)
    assert [(r["rank"], r["index"], r["document"]) for r in rank.rerank(docs, "req", "pos", raw, "doc").orderBy("rank").collect()] == [(1, 1, "d1"), (2, 0, "d0"), (3, 2, "d2")]
    results = spark.createDataFrame([("r", 1, 0.0), ("r", 5, 9.0)], "req string, index int, raw double")
    assert [r.score for r in rank.aligned_scores(docs, results, "req", "pos").orderBy("pos").collect()] == [0.0, 0.5, 0.0]
    again = spark.createDataFrame([("r", 1, 3.0, 1), ("r", 1, 0.0, 2), ("r", 0, 0.0, 3)], "req string, index int, raw double, at int")
    assert [r.score for r in rank.aligned_scores(docs, again, "req", "pos", order="at").orderBy("pos").collect()] == [0.5, 0.5, 0.0]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # with many ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = {}
    for r in rank.top_k(corpus.filter("id < 20"), corpus, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    for i in range(20):
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])
        scores = np.round(np.where(n > 0, x @ x[i] / np.where(n > 0, n, 1), 0), 9)
        best = sorted(range(300), key=lambda j: (-scores[j], j))[:7]
        assert [got[i][k + 1] for k in range(7)] == [(j, scores[j]) for j in best]


def test_scorer_of_nulls_and_session_keys(spark):
    e = tiny.formula_encoder({"logits": 1}, head="rerank")
    pairs = spark.createDataFrame([("the", "x"), (None, "x"), ("the", None)], "q string, d string")
    assert [r.s for r in pairs.select(E.scorer(e)("q", "d").alias("s")).collect()] == [0.5, None, None]
    E._cache.clear()
    first = E.session(tiny.formula_encoder({"x": 2}))
    assert E.session(tiny.formula_encoder({"x": 2})) is first
    others = [E.session(tiny.formula_encoder({"x": 2}, **o)) for o in ({"fixed_shape": True, "max_length": 9}, {"max_length": 9}, {"max_length": 8}, {"max_length": 7})]
    assert all(o is not first for o in others) and len(E._cache) == E.KEPT
    assert [o.limit for o in others] == [9, 9, 8, 7] and all(o.tokenizer.padding is None and o.tokenizer.truncation is None for o in others)


def test_pinned_and_capped_encoding(spark):
    texts = ["the and", "of", "with be is for", "in", "to de la que"]
    plain, pinned = (list(E.encode_rows(tiny.formula_encoder({"x": 4}, batch_size=3, pooling="mean", **o), texts)) for o in ({}, {"pin": True}))
    assert all(np.allclose(a["dense"], b["dense"]) for a, b in zip(plain, pinned)) and len(pinned) == 5
    e = tiny.formula_encoder({"x": 4}, pooling="mean")
    df = spark.createDataFrame([("the and of", 1), ("the", 9), ("the and of", 9), (None, 3), ("x", None)], "t string, n int")
    got = [r.e.dense for r in df.select(E.capped_encoder(e)("t", "n").alias("e")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None and got[4] is None


def test_requests_to_responses(spark, tmp_path):
    from textloom.operators import serve

    lines = [{"request_id": "a", "texts": ["the and of", "with"], "kind": "query", "max_length": 16}, {"request_id": "b", "texts": ["of", None], "kind": "doc"}, {"request_id": "c", "texts": [], "kind": "doc"}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    asked = requests.read_requests(spark, str(tmp_path / "in.json"))
    rows = {r.request_id: r for r in serve.embed_requests(asked, tiny.formula_encoder({"x": 4}, pooling="mean"), resident=32).collect()}
    assert set(rows) == {"a", "b", "c"} and (rows["a"].max_length, rows["b"].max_length) == (32, 256)
    assert rows["a"].token_count == [3, 1] and rows["a"].truncated == [False, False] and rows["a"].token_accounting
    assert len(rows["b"].dense) == 2 and rows["b"].dense[1] is None and rows["b"].token_count is None and rows["b"].truncated is None and not rows["b"].token_accounting
    requests.write_responses(serve.embed_requests(asked, tiny.formula_encoder({"x": 4})), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    pairs = spark.createDataFrame([("r", "the", ["x", None, "y"])], "request_id string, query string, documents array<string>")
    (got,) = serve.rerank_requests(pairs, tiny.formula_encoder({"logits": 1}, head="rerank")).collect()
    assert got.scores == pytest.approx([1 / (1 + np.exp(-0.5)), 0.0, 1 / (1 + np.exp(-0.5))])


def test_models_load_by_name(spark, tmp_path):
    def put(code, file, model):
        where = tmp_path / ("models--" + code.replace("/", "--")) / "snapshots" / "r1"
        (where / file).parent.mkdir(parents=True, exist_ok=True)
        (where / file).write_bytes(model)
        (where / "tokenizer.json").write_text(tiny.tiny_tokenizer([*tiny.WORDS, "[PAD]"]))
        (where / "config.json").write_text("{}")
        (where / "special_tokens_map.json").write_text("{}")
        (where / "tokenizer_config.json").write_text(json.dumps({"model_max_length": 64, "pad_token": "[PAD]"}))

    table = tiny.formula_table(4)
    table = np.vstack([table, np.zeros((1, 4))])
    put("Xenova/all-MiniLM-L12-v2", "onnx/model.onnx", tiny.gather_model({"last_hidden_state": table}))
    put("onnx-community/embeddinggemma-300m-ONNX", "onnx/model.onnx", tiny.gather_model({"last_hidden_state": -table, "sentence_embedding": table}))
    put("Qwen/Qwen3-Embedding-0.6B", "onnx/x.onnx", tiny.gather_model({"last_hidden_state": table}))
    (tmp_path / "models--Qwen--Qwen3-Embedding-0.6B/snapshots/r1/config.json").write_text('{"hidden_size": 1024}')
    put("BAAI/bge-reranker-base", "onnx/model.onnx", tiny.gather_model({"logits": table}))
    df = spark.createDataFrame([("the and",), ("of",)], "text string")
    mean = models.load("dense", "allminilml12v2", str(tmp_path))
    assert mean.pooling == "mean" and mean.quantization == "none"
    first, second = (np.array(r.encoding.dense) for r in E.encode(df, mean).collect())
    both = (table[1] + table[2]) / 2
    assert np.allclose(first, both / np.linalg.norm(both), atol=1e-5) and np.allclose(second, table[4] / np.linalg.norm(table[4]), atol=1e-5)
    gemma = models.load("dense", "EmbeddingGemma300M", str(tmp_path))
    assert gemma.output == "sentence_embedding" and np.allclose(E.encode(df, gemma).first().encoding.dense, first, atol=1e-5)
    decoder = models.load("decoder", "Qwen/Qwen3-Embedding-0.6B", str(tmp_path), file="onnx/x.onnx")
    assert decoder.pad_left and np.allclose(E.encode(df, decoder).first().encoding.dense, table[2] / np.linalg.norm(table[2]), atol=1e-5)
    scorer = E.scorer(models.load("rerank", "BAAI/bge-reranker-base", str(tmp_path)))
    assert df.select(scorer("text", "text").alias("s")).first().s == pytest.approx(table[1, 0])
    with pytest.raises(FileNotFoundError):
        models.load("dense", "BGEBaseENV15", str(tmp_path))
    with pytest.raises(ValueError, match="file="):
        models.load("decoder", "Qwen/Qwen3-Embedding-4B", str(tmp_path))
    assert models.load("dense", "AllMiniLML12V2", str(tmp_path), batch_size=7).batch_size == 7


def test_image_models_load_by_name(spark, tmp_path):
    """A model that is the mean of each channel."""
    from textloom.plans.tiny import _field, _node, _value_info

    graph = _field(1, _node("GlobalAveragePool", ["pixel_values"], ["pooled"])) + _field(1, _node("Flatten", ["pooled"], ["image_embeds"])) + _field(2, "t")
    graph += _field(11, _value_info("pixel_values", 1, ["n", "c", "h", "w"])) + _field(12, _value_info("image_embeds", 1, ["n", "c"]))
    where = tmp_path / "models--Qdrant--clip-ViT-B-32-vision" / "snapshots" / "r"
    where.mkdir(parents=True)
    (where / "model.onnx").write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13)))
    (where / "preprocessor_config.json").write_text(json.dumps({"do_resize": True, "size": {"height": 2, "width": 2}, "do_rescale": True, "rescale_factor": 1 / 255, "do_normalize": False, "do_center_crop": False}))
    config, run = images.load_image_model("Qdrant/clip-ViT-B-32-vision", str(tmp_path))
    picture = b"P6 2 2 255\n" + bytes([255, 0, 0] * 2 + [0, 255, 0] * 2)
    df = spark.createDataFrame([(bytearray(picture),), (None,)], "content binary")
    rows = images.embed_images(df, config, run).collect()
    assert np.allclose(rows[0].embedding, [0.5**0.5, 0.5**0.5, 0], atol=1e-4) and rows[1].embedding is None


@given(st.lists(st.integers(), max_size=40), st.integers(2, 9))
@settings(max_examples=50, deadline=None)
def test_pinning_round_trip(rows, size):
    padded, at = layout.pinned(rows, size, -1)
    assert len(padded) % size == 0 and layout.unpinned(padded, at) == rows
    if at:
        with pytest.raises(ValueError):
            layout.unpinned(padded[: at[-1]], at)


def test_settling():
    tries = iter([[1], RuntimeError("no"), [1, 2]])

    def run():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert layout.settled(run, 2) == [1, 2]
    with pytest.raises(RuntimeError, match="1 rows of 2"):
        layout.settled(lambda: [1], 2)
    assert layout.attention_bytes(4, 1024) == 512 << 20
    assert layout.should_pin("off", ["MIGraphXExecutionProvider"]) is False and layout.should_pin(None, ["CPUExecutionProvider"]) is False


def test_models(spark):
    found = models.models(spark)
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"dense": 46, "sparse": 2, "dual": 1, "joint": 1, "rerank": 4, "image": 5, "decoder": 4, "moe": 1}
    assert models.get_model("dense", "bgem3").dimension == 1024 and models.get_model("rerank", "BAAI/BGE-reranker-base").kind == "rerank"
    with pytest.raises(ValueError):
        models.get_model("dense", "BAAI/bge-m3")


def test_output_selection():
    outputs = {"a": np.zeros(1), "last_hidden_state": np.ones(1)}
    assert E.select_output(outputs)[0] == 1 and E.select_output({"x": np.ones(1)})[0] == 1 and E.select_output(outputs, "a")[0] == 0
    with pytest.raises(ValueError):
        E.select_output({"a": 1, "b": 2})
    assert E.select_by_fragment({"dense_vecs": 2, "hidden": 3}, "dense", 2) == "dense_vecs"
    assert E.select_by_fragment({"x": 2, "y": 3}, "dense", 2) == "x"
    with pytest.raises(ValueError):
        E.select_by_fragment({"x": 2, "y": 2}, "dense", 2)


def test_encoding_does_not_depend_on_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the and of", "with", "", None, "unknown words here"] * 5)], "id int, text string")
    one_batch = {r.id: r.encoding for r in E.encode(df, tiny.tiny_encoder()).collect()}
    small = tiny.tiny_encoder()
    small = E.replace(small, batch_size=2)
    assert {r.id: r.encoding for r in E.encode(df.repartition(3), small).collect()} == one_batch
    assert one_batch[3].dense is None if one_batch[3] else True
    assert np.linalg.norm(one_batch[0].dense) == pytest.approx(1, abs=1e-5)
    assert E.dimension(E.encode(df, small).select("encoding.dense"), "dense") == 8
    assert E.dimension(E.encode(df.limit(0), small).select("encoding.dense"), "dense") is None


def test_sparse_encoding_and_guards(spark):
    e = tiny.tiny_encoder(head="lexical", weight=tuple([1.0] * 8), bias=5.0)
    got = E.encode(spark.createDataFrame([("el los el zzz",)], "text string"), e).first().encoding.sparse
    assert got["indices"] == sorted(got["indices"]) and len(got["indices"]) == 2 and min(got["values"]) > 0
    with pytest.raises(ValueError):
        E.Encoder(model="x", tokenizer="y", batch_size=0)
    with pytest.raises(ValueError):
        E.check_providers(("NoSuchProvider",))
    many = spark.range(70).selectExpr("cast(id as string) text")
    with pytest.raises(ValueError, match="one batch"):
        E.encode(many, tiny.tiny_encoder(quantization="dynamic"))
    assert E.encode(many.limit(5), tiny.tiny_encoder(quantization="dynamic")).count() == 5
    with pytest.raises(Exception, match="logits"):
        spark.createDataFrame([("a", "b")], "q string, d string").select(E.scorer(tiny.tiny_encoder())("q", "d")).collect()
    raw = E.raw_outputs(many.limit(2), tiny.tiny_encoder(), lambda outputs, mask: list(outputs["last_hidden_state"].max(axis=(1,))))
    assert [len(r["values"]) for r in raw.collect()] == [8, 8]


def test_selfcheck(spark, tmp_path):
    v = np.arange(4, dtype=np.float32)
    path = str(tmp_path / "ref.bin")
    vector_files.write_vector(path, v)
    assert vector_files.read_vector(path).tolist() == v.tolist()
    assert selfcheck.check_file(lambda t: v, path).verified
    assert selfcheck.check(lambda t: -v, v) == selfcheck.Status(-1.0, False, False, 3, "below the bar")
    failed = selfcheck.check(lambda t: 1 / 0, v)
    assert failed.cosine is None and not failed.serving and selfcheck.check_file(lambda t: v, path + "x").cosine is None
    assert selfcheck.strict_cosine(v, v[:2]) == -1 and selfcheck.strict_cosine(v * 0, v) == -1
    assert selfcheck.regenerate(lambda t: v + 1, path)["differ"] == 4 and vector_files.read_vector(path).tolist() == v.tolist()
    selfcheck.regenerate(lambda t: v + 1, path, confirmed=True)
    assert vector_files.read_vector(path).tolist() == (v + 1).tolist()
    assert selfcheck.frame(spark, failed).first().cosine is None


def test_requests_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.json")
    open(path, "w").write('{"request_id": "a", "texts": ["x", "y"]}\n{"request_id": "b", "texts": [], "max_length": 9}\n')
    asked = requests.read_requests(spark, path)
    assert {(r.request_id, r.max_length) for r in asked.collect()} == {("a", 0), ("b", 9)}
    rows = requests.texts_of(asked)
    assert [r.texts for r in requests.responses(rows, "request_id", "pos", {"texts": "text"}).collect()] == [["x", "y"]]


@given(st.integers(1, 4000), st.integers(1, 4000))
@settings(max_examples=200, deadline=None)
def test_smart_size(h, w):
    s = images.SmartSize()
    if max(h, w) / min(h, w) > s.aspect:
        with pytest.raises(ValueError):
            s.of(h, w)
        return
    a, b = s.of(h, w)
    assert a % s.factor == b % s.factor == 0 and a * b <= s.most + s.factor * max(a, b) and a * b >= s.least or min(a, b) == s.factor


def test_images(spark, tmp_path):
    x = (np.arange(6 * 4 * 3) * 3 % 256).astype(np.uint8).reshape(6, 4, 3)
    raw = b"P6\n4 6\n255\n" + x.tobytes()
    assert (image_files.decode(raw) == x).all()
    assert images.resize(x, 6, 4) is x and images.resize(np.full((5, 7, 3), 9, np.uint8), 3, 11).tolist() == np.full((3, 11, 3), 9).tolist()
    assert images.center_crop(x, 2, 2).tolist() == x[2:4, 1:3].tolist() and images.center_crop(x, 8, 8)[0].sum() == 0
    steps = images.pipeline({"size": {"shortest_edge": 8}, "do_center_crop": True, "crop_size": 6, "do_normalize": True, "image_mean": [0.5] * 3, "image_std": [0.5] * 3})
    assert steps(x).shape == (3, 6, 6)
    assert images.pipeline({"image_processor_type": "ConvNextImageProcessor", "size": {"shortest_edge": 16}})(x).shape == (3, 16, 16)
    with pytest.raises(ValueError):
        images.pipeline({"image_processor_type": "Other"})
    patches, grid = images.patchify(np.arange(3 * 8 * 8, dtype=np.float32).reshape(3, 8, 8), patch=2, merge=2)
    assert patches.shape == (16, 24) and grid == (1, 4, 4) and images.position_ids(grid)[:4].tolist() == [[0, 0], [0, 1], [1, 0], [1, 1]]
    (tmp_path / "a.ppm").write_bytes(raw)
    df = image_files.read_images(spark, str(tmp_path), "*.ppm")
    out = images.embed_images(df, {"size": 4}, lambda batch: batch.reshape(len(batch), -1)[:, :5]).first()
    assert len(out.embedding) == 5


def test_png():
    import struct
    import zlib

    x = np.random.default_rng(0).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    rows = b""
    for y in range(5):
        line = x[y].reshape(-1).astype(np.int64)
        above = x[y - 1].reshape(-1).astype(np.int64) if y else np.zeros(12, np.int64)
        kind = y % 3
        rows += bytes([kind]) + bytes((line if kind == 0 else (line - np.concatenate((np.zeros(3, np.int64), line[:-3]))) % 256 if kind == 1 else (line - above) % 256).astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (image_files.decode(raw) == x).all()


def test_all_heads_with_tiny_models(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(9)]
    tokenizer = tiny.tiny_tokenizer(words)
    table, second, third = rng.standard_normal((10, 6)), rng.standard_normal((10, 1)), rng.standard_normal((10, 4))
    texts = ["w3 w5 w3 w8", "w7", "w4 w6"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ids = [[int(w[1:]) + 1 for w in t.split()] for t in texts]

    def run(models, **settings):
        e = E.Encoder(model=tiny.gather_model(models), tokenizer=tokenizer, max_length=8, **settings)
        return [r.encoding for r in E.encode(df.repartition(2), e).orderBy("id").collect()]

    for e, i in zip(run({"dense_out": table, "other": third}, output="dense_out", normalize=False), ids):
        assert np.allclose(e.dense, table[i[0]], atol=1e-6)
    for pooling, at in (("last", -1), ("last_position", -1)):
        for e, i in zip(run({"x": table}, pooling=pooling, pad_left=pooling == "last_position", inner_epsilon=True), ids):
            assert np.allclose(e.dense, table[i[at]] / np.linalg.norm(table[i[at]]), atol=1e-5)
    for e, i in zip(run({"logits": table}, head="splade"), ids):
        best = np.log1p(np.maximum(table[i], 0)).max(axis=0)
        assert e.sparse["indices"] == np.flatnonzero(best > 0).tolist() and np.allclose(e.sparse["values"], best[best > 0], atol=1e-6)
    weights = {k: max(float(table[k] @ np.arange(6)), 0) for i in ids for k in i}
    dual = run({"pooled_dense": table, "hidden_states": table}, head="dual", weight=tuple(range(6)))
    for e, i in zip(dual, ids):
        assert np.allclose(e.dense, table[i[0]] / np.linalg.norm(table[i[0]]), atol=1e-5)
        kept = sorted(k for k in set(i) if k > 3 and weights[k] > 0)
        assert e.sparse["indices"] == kept and np.allclose(e.sparse["values"], [weights[k] for k in kept], atol=1e-5)
    for e, i in zip(run({"pooled_a": table, "b": second, "c": third}, head="joint"), ids):
        kept = sorted(k for k in set(i) if k > 3 and second[k, 0] > 0)
        assert np.allclose(e.dense, table[i[0]], atol=1e-6) and e.sparse["indices"] == kept
        assert len(e.multi) == len(i) - 1
    with pytest.raises(Exception, match="three outputs"):
        run({"pooled_a": table, "b": second}, head="joint")
    scorer = E.scorer(E.Encoder(model=tiny.gather_model({"logits": second}), tokenizer=tokenizer, head="rerank"))
    pairs = spark.createDataFrame([("r", 0, "w1", "w2"), ("r", 1, "w4", "w2")], "req string, pos int, q string, d string")
    assert {r["index"]: round(r.raw, 5) for r in rank.rerank(pairs, "req", "pos", scorer("q", "d")).collect()} == {0: round(float(second[2, 0]), 5), 1: round(float(second[5, 0]), 5)}
    fixed = run({"x": table}, fixed_shape=True, pooling="mean")
    for a, b in zip(fixed, run({"x": table}, pooling="mean")):
        assert np.allclose(a.dense, b.dense, atol=1e-5)


def test_streaming(spark, tmp_path):
    from textloom.streaming.inference import read_rows, run_available

    rows = spark.createDataFrame([(i, "the and") for i in range(10)], "id int, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_rows(spark, str(tmp_path / "in"), rows.schema, files_a_batch=1)
    for _ in range(2):  # the second run finds nothing new
        run_available(stream, lambda df: E.encode(df, tiny.tiny_encoder()).select("id", F.size("encoding.dense").alias("n")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).filter("n = 8").collect()) == list(range(10))


def test_settings(spark, monkeypatch):
    from textloom.operators.settings import Settings

    assert Settings.read({}) == Settings() and Settings().max_length == 256
    assert Settings.read({"max_batch": "8", "pin_shapes": "on", "providers": "A, B"}) == Settings(max_batch=8, pin_shapes=True, providers=("A", "B"))
    for bad in ({"max_batch": "many"}, {"max_batch": "0"}, {"pin_shapes": "perhaps"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            Settings.read(bad)
    monkeypatch.setenv("TEXTLOOM_MAX_LENGTH", "99")
    assert Settings.from_env().max_length == 99
    spark.conf.set("spark.textloom.max_batch", "3")
    assert Settings.from_session(spark).max_batch == 3
