"""Models by name: the right head, formulas and files for each row of the registry."""

import json
import os
import struct

import numpy as np
import pytest

from textloom.functions import arrays
from textloom.operators import encode as E
from textloom.operators import models
from textloom.plans import tiny
from textloom.sources import head_weights
from textloom.sources.tokenizer_files import find_snapshot

WEIGHT, BIAS = tuple(k / 2 for k in range(8)), 0.25
TEXT = "the and zz the of"


EXPERTS = {"n_embd": 768, "num_attention_heads": 12, "n_inner": 3072, "n_layer": 12, "n_positions": 40, "vocab_size": 9}


def expected_head():
    ids = np.array([[1, 2, 0, 1, 4]])
    h = tiny.formula_table(8)[ids]
    return arrays.lexical_head(h, ids, np.ones_like(ids), np.array(WEIGHT, np.float32), BIAS)[0], arrays.l2_normalize(h[:, 0])[0]


def one(spark, e):
    return E.encode(spark.createDataFrame([(TEXT,)], "text string"), e).first().encoding


def test_two_heads_by_name(spark, tmp_path):
    cache = tiny.two_headed(str(tmp_path), WEIGHT, BIAS)
    (ids, values), dense = expected_head()
    assert len(ids) == 1  # of known words above the special ids
    for ship in (False, True):
        both = one(spark, models.load("dual", "BAAI/bge-m3", cache, ship=ship, dimension=8))
        assert both.sparse["indices"] == ids.tolist() and np.allclose(both.sparse["values"], values) and np.allclose(both.dense, dense, atol=1e-6)
        lexical = one(spark, models.load("sparse", "baai/BGE-M3", cache, ship=ship, dimension=8))
        assert lexical.sparse == both.sparse and lexical.dense is None
        assert np.allclose(one(spark, models.load("dense", "BGEM3", cache, ship=ship, output="sentence_embedding")).dense, dense, atol=1e-6)
    e = models.load("dual", "BAAI/bge-m3", cache, dimension=8)
    assert (e.head, e.max_length, e.providers, e.weight, e.bias) == ("dual", 512, ("CPUExecutionProvider",), WEIGHT, BIAS)


def test_a_head_without_weights_is_an_error(tmp_path):
    cache = tiny.two_headed(str(tmp_path), WEIGHT, BIAS)
    with pytest.raises(ValueError, match="8 weights for 1024"):
        models.load("dual", "BAAI/bge-m3", cache)
    os.remove(next(tmp_path.rglob("sparse_linear.safetensors")))
    for kind in ("dual", "sparse"):
        with pytest.raises(FileNotFoundError, match="sparse_linear"):
            models.load(kind, "BAAI/bge-m3", cache, dimension=8)
    other = tmp_path / "head.json"
    other.write_text(json.dumps({"weight": [[1.0] * 8], "bias": [2.0]}))
    assert models.load("sparse", "BAAI/bge-m3", cache, head_weights=str(other), dimension=8).bias == 2.0
    with pytest.raises(ValueError, match="does not fit"):
        E.encode_pass(models.load("sparse", "BAAI/bge-m3", cache, head_weights=str(other), dimension=8, weight=(1.0,)), E.tokenise(tiny.formula_encoder({"x": 8}), ["the"]), [0], None, 1)


def test_head_files(tmp_path):
    path = tmp_path / "head.safetensors"
    path.write_bytes(head_weights.write_tensors({"weight": np.array([[1.5, -2.0]]), "bias": np.array([0.5])}))
    assert head_weights.read_head(str(path)) == ((1.5, -2.0), 0.5)
    header = {"__metadata__": {"format": "pt"}, "weight": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}, "bias": {"dtype": "F16", "shape": [1], "data_offsets": [4, 6]}}
    body = struct.pack("<HH", 0x3FC0, 0xC000) + np.array([0.5], "<f2").tobytes()
    path.write_bytes(struct.pack("<Q", len(json.dumps(header))) + json.dumps(header).encode() + body)
    assert head_weights.read_head(str(path)) == ((1.5, -2.0), 0.5)
    for bad in (b"", b"\xff" * 20, head_weights.write_tensors({"weight": np.zeros(0), "bias": np.zeros(1)}), head_weights.write_tensors({"bias": np.zeros(1)}), head_weights.write_tensors({"weight": np.array([np.nan]), "bias": np.zeros(1)}), head_weights.write_tensors({"weight": np.ones(2), "bias": np.zeros(2)})):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            head_weights.read_head(str(path))


def test_splade_stays_splade(tmp_path, spark):
    cache = tiny.hub_cache(str(tmp_path), "Qdrant/Splade_PP_en_v1", {"model.onnx": tiny.gather_model({"logits": tiny.formula_table(9)})})
    e = models.load("sparse", "Qdrant/Splade_PP_en_v1", cache)
    assert e.head == "splade" and not e.weight
    x = tiny.formula_table(9)[[1, 2, 0, 1, 4]].max(axis=0)
    assert one(spark, e).sparse["indices"] == np.flatnonzero(x > 0).tolist()


def test_mixture_of_experts_formulas(tmp_path, spark):
    cache = tiny.hub_cache(str(tmp_path), "nomic-ai/nomic-embed-text-v2-moe", {"x.onnx": tiny.gather_model({"last_hidden_state": tiny.formula_table(4) * 1e-6}), "config.json": json.dumps(EXPERTS).encode()})
    e = models.load("moe", "nomic-ai/nomic-embed-text-v2-moe", cache, file="x.onnx")
    assert (e.pooling, e.inner_epsilon, e.pad_id, e.max_length) == ("mean_clamped", True, 1, 40)
    mean = (tiny.formula_table(4) * 1e-6)[[1, 2, 0, 1, 4]].mean(axis=0)
    got = one(spark, e).dense
    assert np.allclose(got, mean / np.sqrt((mean**2).sum() + 1e-12), rtol=1e-4) and not np.allclose(got, mean / (np.linalg.norm(mean) + 1e-12), rtol=1e-2)
    empty = E.encode(spark.createDataFrame([("",)], "text string"), e).first().encoding.dense
    assert empty == [0.0] * 4  # a count of none is held at the least one


def test_decoders_read_plain_and_nested_settings(tmp_path):
    plain = {"hidden_size": 1024, "max_position_embeddings": 40}
    for config in (plain, {"text_config": plain, "vision_config": {"hidden_size": 7}}):
        cache = tiny.hub_cache(str(tmp_path), "Qwen/Qwen3-Embedding-0.6B", {"x.onnx": tiny.gather_model({"h": tiny.formula_table(4)}), "config.json": json.dumps(config).encode()})
        e = models.load("decoder", "Qwen/Qwen3-Embedding-0.6B", cache, file="x.onnx")
        assert (e.max_length, e.pad_left, e.inner_epsilon, e.pooling) == (40, True, True, "last_position")
        assert models.load("decoder", "Qwen/Qwen3-Embedding-0.6B", cache, file="x.onnx", max_length=9).max_length == 9
    for bad in ({}, {"text_config": 3}, {"vision_config": plain}, {"hidden_size": 8}):
        tiny.hub_cache(str(tmp_path), "Qwen/Qwen3-Embedding-0.6B", {"config.json": json.dumps(bad).encode()})
        with pytest.raises(ValueError):
            models.load("decoder", "Qwen/Qwen3-Embedding-0.6B", cache, file="x.onnx")


def test_files_are_of_one_revision(tmp_path):
    root = tmp_path / "models--a--b" / "snapshots"
    for revision, files, at in (("old", ("model.onnx", "tokenizer.json"), 100), ("newer", ("tokenizer.json",), 200), ("new", ("model.onnx", "tokenizer.json"), 150)):
        for f in files:
            (root / revision).mkdir(parents=True, exist_ok=True)
            (root / revision / f).write_text("")
            os.utime(root / revision / f, (at, at))
    assert find_snapshot(str(tmp_path), "a/b", ("model.onnx", "tokenizer.json")).endswith("/new")
    assert find_snapshot(str(tmp_path), "a/b", ("tokenizer.json",)).endswith("/newer")
    assert find_snapshot(str(tmp_path), "a/b", ("other",)) is None and find_snapshot(str(tmp_path), "a/c", ("model.onnx",)) is None


def test_every_text_model_of_the_registry_loads(tmp_path):
    """With the files that its row names, each gives the head, pooling and output of its row."""
    model = tiny.gather_model({"x": tiny.formula_table(4)})
    for m in models.registry():
        if m.kind not in models.HEADS:
            continue
        files = {m.file or "x.onnx": model}
        if m.kind == "decoder":
            files["config.json"] = json.dumps({"text_config": {"hidden_size": m.dimension}}).encode()
        if m.kind == "moe":
            files["config.json"] = json.dumps(EXPERTS).encode()
        if (m.kind, m.variant) in models.HEAD_FILES:
            files["sparse_linear.safetensors"] = head_weights.write_tensors({"weight": np.zeros(1024), "bias": np.zeros(1)})
        cache = tiny.hub_cache(str(tmp_path / m.kind / m.variant), m.code, files)
        e = models.load(m.kind, m.variant if m.kind == "dense" else m.code, cache, **({} if m.file else {"file": "x.onnx"}))
        assert e.quantization == m.quantization and e.pooling == ('mean_clamped' if m.kind == 'moe' else m.pooling or 'cls') and (m.output_key is None or e.output == m.output_key)
        want = {"sparse": "lexical" if m.variant == "BGEM3" else "splade", "decoder": "dense", "moe": "dense"}.get(m.kind, m.kind)
        assert e.head == want and bool(e.weight) == (want in ("lexical", "dual"))


def test_settings_of_experts(tmp_path):
    found = models.expert_config(json.dumps(EXPERTS | {"num_experts": 4}))
    assert found["hidden_size"] == 768 and found["num_experts"] == 4 and found["moe_top_k"] == 2 and found["pad_token_id"] == 1 and not models.SPELLINGS.keys() & found.keys()
    for bad in ({}, {k: v for k, v in EXPERTS.items() if k != "n_embd"}, EXPERTS | {"hidden_size": 768}):
        with pytest.raises(ValueError):
            models.expert_config(json.dumps(bad))
    cache = tiny.hub_cache(str(tmp_path), "nomic-ai/nomic-embed-text-v2-moe", {"x.onnx": b"", "config.json": json.dumps(EXPERTS | {"n_embd": 8}).encode()})
    with pytest.raises(ValueError, match="8 dimensions"):
        models.load("moe", "nomic-ai/nomic-embed-text-v2-moe", cache, file="x.onnx")


def test_load_by_the_sessions_settings(spark, tmp_path):
    cache = tiny.hub_cache(str(tmp_path), "Xenova/all-MiniLM-L12-v2", {"onnx/model.onnx": tiny.gather_model({"last_hidden_state": tiny.formula_table(4)})})
    with pytest.raises(ValueError, match="model_cache"):
        models.load_from(spark, "dense", "AllMiniLML12V2")
    stated = {"model_cache": cache, "max_length": "33", "max_batch": "5", "pin_shapes": "on"}
    try:
        for k, v in stated.items():
            spark.conf.set(f"spark.textloom.{k}", v)
        e = models.load_from(spark, "dense", "AllMiniLML12V2", batch_size=7)
        assert (e.max_length, e.batch_size, e.pin, e.pooling) == (33, 7, True, "mean")
        assert E.encode(spark.createDataFrame([("the and",)], "text string"), e).first().encoding.dense is not None
    finally:
        for k in stated:
            spark.conf.unset(f"spark.textloom.{k}")
