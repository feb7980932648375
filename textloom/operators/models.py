"""Registries of known models, as tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.head_weights import read_head
from ..sources.tokenizer_files import find_snapshot, load_tokenizer
from .encode import DEFAULT_LENGTH, Encoder
from .settings import Settings

# The dense text models: variant, code, file, dimension, pooling, quantisation.
DENSE = """
AllMiniLML6V2 | Qdrant/all-MiniLM-L6-v2-onnx | model.onnx | 384 | mean | none
AllMiniLML6V2Q | Xenova/all-MiniLM-L6-v2 | onnx/model_quantized.onnx | 384 | mean | dynamic
AllMiniLML12V2 | Xenova/all-MiniLM-L12-v2 | onnx/model.onnx | 384 | mean | none
AllMiniLML12V2Q | Xenova/all-MiniLM-L12-v2 | onnx/model_quantized.onnx | 384 | mean | dynamic
AllMpnetBaseV2 | Xenova/all-mpnet-base-v2 | onnx/model.onnx | 768 | mean | none
BGEBaseENV15 | Xenova/bge-base-en-v1.5 | onnx/model.onnx | 768 | cls | none
BGEBaseENV15Q | Qdrant/bge-base-en-v1.5-onnx-Q | model_optimized.onnx | 768 | cls | static
BGELargeENV15 | Xenova/bge-large-en-v1.5 | onnx/model.onnx | 1024 | cls | none
BGELargeENV15Q | Qdrant/bge-large-en-v1.5-onnx-Q | model_optimized.onnx | 1024 | cls | static
BGESmallENV15 | Xenova/bge-small-en-v1.5 | onnx/model.onnx | 384 | cls | none
BGESmallENV15Q | Qdrant/bge-small-en-v1.5-onnx-Q | model_optimized.onnx | 384 | cls | static
NomicEmbedTextV1 | nomic-ai/nomic-embed-text-v1 | onnx/model.onnx | 768 | mean | none
NomicEmbedTextV15 | nomic-ai/nomic-embed-text-v1.5 | onnx/model.onnx | 768 | mean | none
NomicEmbedTextV15Q | nomic-ai/nomic-embed-text-v1.5 | onnx/model_quantized.onnx | 768 | mean | dynamic
ParaphraseMLMiniLML12V2Q | Qdrant/paraphrase-multilingual-MiniLM-L12-v2-onnx-Q | model_optimized.onnx | 384 | mean | static
ParaphraseMLMiniLML12V2 | Xenova/paraphrase-multilingual-MiniLM-L12-v2 | onnx/model.onnx | 384 | mean | none
ParaphraseMLMpnetBaseV2 | Xenova/paraphrase-multilingual-mpnet-base-v2 | onnx/model.onnx | 768 | mean | none
BGESmallZHV15 | Xenova/bge-small-zh-v1.5 | onnx/model.onnx | 512 | cls | none
BGELargeZHV15 | Xenova/bge-large-zh-v1.5 | onnx/model.onnx | 1024 | cls | none
BGEM3 | BAAI/bge-m3 | onnx/model.onnx | 1024 | cls | none
ModernBertEmbedLarge | lightonai/modernbert-embed-large | onnx/model.onnx | 1024 | mean | none
MultilingualE5Small | intfloat/multilingual-e5-small | onnx/model.onnx | 384 | mean | none
MultilingualE5Base | intfloat/multilingual-e5-base | onnx/model.onnx | 768 | mean | none
MultilingualE5Large | Qdrant/multilingual-e5-large-onnx | model.onnx | 1024 | mean | none
MxbaiEmbedLargeV1 | mixedbread-ai/mxbai-embed-large-v1 | onnx/model.onnx | 1024 | cls | none
MxbaiEmbedLargeV1Q | mixedbread-ai/mxbai-embed-large-v1 | onnx/model_quantized.onnx | 1024 | cls | dynamic
GTEBaseENV15 | Alibaba-NLP/gte-base-en-v1.5 | onnx/model.onnx | 768 | cls | none
GTEBaseENV15Q | Alibaba-NLP/gte-base-en-v1.5 | onnx/model_quantized.onnx | 768 | cls | dynamic
GTELargeENV15 | Alibaba-NLP/gte-large-en-v1.5 | onnx/model.onnx | 1024 | cls | none
GTELargeENV15Q | Alibaba-NLP/gte-large-en-v1.5 | onnx/model_quantized.onnx | 1024 | cls | dynamic
ClipVitB32 | Qdrant/clip-ViT-B-32-text | model.onnx | 512 | mean | none
JinaEmbeddingsV2BaseCode | jinaai/jina-embeddings-v2-base-code | onnx/model.onnx | 768 | mean | none
JinaEmbeddingsV2BaseEN | jinaai/jina-embeddings-v2-base-en | model.onnx | 768 | mean | none
EmbeddingGemma300M | onnx-community/embeddinggemma-300m-ONNX | onnx/model.onnx | 768 | mean | none
EmbeddingGemma300MQ4 | onnx-community/embeddinggemma-300m-ONNX | onnx/model_q4.onnx | 768 | mean | none
EmbeddingGemma300MQ | onnx-community/embeddinggemma-300m-ONNX | onnx/model_quantized.onnx | 768 | mean | dynamic
SnowflakeArcticEmbedXS | snowflake/snowflake-arctic-embed-xs | onnx/model.onnx | 384 | cls | none
SnowflakeArcticEmbedXSQ | snowflake/snowflake-arctic-embed-xs | onnx/model_quantized.onnx | 384 | cls | dynamic
SnowflakeArcticEmbedS | snowflake/snowflake-arctic-embed-s | onnx/model.onnx | 384 | cls | none
SnowflakeArcticEmbedSQ | snowflake/snowflake-arctic-embed-s | onnx/model_quantized.onnx | 384 | cls | dynamic
SnowflakeArcticEmbedM | Snowflake/snowflake-arctic-embed-m | onnx/model.onnx | 768 | cls | none
SnowflakeArcticEmbedMQ | Snowflake/snowflake-arctic-embed-m | onnx/model_quantized.onnx | 768 | cls | dynamic
SnowflakeArcticEmbedMLong | snowflake/snowflake-arctic-embed-m-long | onnx/model.onnx | 768 | cls | none
SnowflakeArcticEmbedMLongQ | snowflake/snowflake-arctic-embed-m-long | onnx/model_quantized.onnx | 768 | cls | dynamic
SnowflakeArcticEmbedL | snowflake/snowflake-arctic-embed-l | onnx/model.onnx | 1024 | cls | none
SnowflakeArcticEmbedLQ | snowflake/snowflake-arctic-embed-l | onnx/model_quantized.onnx | 1024 | cls | dynamic
"""
# Models of the other families: variant, code, file, dimension (- where it has none).
OTHERS = {
    "sparse": "SPLADEPPV1 | Qdrant/Splade_PP_en_v1 | model.onnx | -\nBGEM3 | BAAI/bge-m3 | onnx/model.onnx | -",
    "dual": "BGEM3 | BAAI/bge-m3 | onnx/model.onnx | 1024",
    "joint": "BGEM3Q | gpahal/bge-m3-onnx-int8 | model_quantized.onnx | 1024",
    "rerank": "BGERerankerBase | BAAI/bge-reranker-base | onnx/model.onnx | -\nBGERerankerV2M3 | perlets/bge-reranker-v2-m3 | onnx/model.onnx | -\nJINARerankerV1TurboEn | jinaai/jina-reranker-v1-turbo-en | onnx/model.onnx | -\nJINARerankerV2BaseMultilingual | jinaai/jina-reranker-v2-base-multilingual | onnx/model.onnx | -",
    "image": "ClipVitB32 | Qdrant/clip-ViT-B-32-vision | model.onnx | 512\nResnet50 | Qdrant/resnet50-onnx | model.onnx | 2048\nUnicomVitB16 | Qdrant/Unicom-ViT-B-16 | model.onnx | 768\nUnicomVitB32 | Qdrant/Unicom-ViT-B-32 | model.onnx | 512\nNomicEmbedVisionV15 | nomic-ai/nomic-embed-vision-v1.5 | onnx/model.onnx | 768",
    "decoder": "Qwen3Embedding06B | Qwen/Qwen3-Embedding-0.6B | - | 1024\nQwen3Embedding4B | Qwen/Qwen3-Embedding-4B | - | 2560\nQwen3Embedding8B | Qwen/Qwen3-Embedding-8B | - | 4096\nQwen3VLEmbedding2B | Qwen/Qwen3-VL-Embedding-2B | - | 2048",
    "moe": "NomicEmbedTextV2MoE | nomic-ai/nomic-embed-text-v2-moe | - | 768",
}
# Files beside a model's own: its numbers, and the head's weights of models with a lexical head.
BESIDE = {
    ("dense", "BGEM3"): ("onnx/model.onnx_data",),
    ("dense", "MultilingualE5Large"): ("model.onnx_data",),
    ("dense", "EmbeddingGemma300M"): ("onnx/model.onnx_data",),
    ("dense", "EmbeddingGemma300MQ4"): ("onnx/model_q4.onnx_data",),
    ("dense", "EmbeddingGemma300MQ"): ("onnx/model_quantized.onnx_data",),
    ("sparse", "BGEM3"): ("onnx/model.onnx_data",),
    ("dual", "BGEM3"): ("onnx/model.onnx_data",),
    ("rerank", "BGERerankerV2M3"): ("onnx/model.onnx_data",),
}
HEAD_FILES = {("sparse", "BGEM3"): "sparse_linear.safetensors", ("dual", "BGEM3"): "sparse_linear.safetensors"}
#: How models of the other families are pooled, where they are.
POOLING = {"decoder": "last_position", "moe": "mean", "image": "cls"}
#: The output that is read by name instead of by precedence.
OUTPUT_KEYS = {"EmbeddingGemma300M": "sentence_embedding", "EmbeddingGemma300MQ4": "sentence_embedding", "EmbeddingGemma300MQ": "sentence_embedding"}
SCHEMA = "kind string, variant string, code string, file string, dimension int, pooling string, quantization string, output_key string"


@dataclass(frozen=True)
class ModelInfo:
    kind: str
    variant: str
    code: str
    file: str | None
    dimension: int | None
    pooling: str | None
    quantization: str
    output_key: str | None


def registry() -> list[ModelInfo]:
    found = []
    for line in DENSE.strip().splitlines():
        variant, code, file, dim, pooling, quant = (x.strip() for x in line.split("|"))
        found.append(ModelInfo("dense", variant, code, file, int(dim), pooling, quant, OUTPUT_KEYS.get(variant)))
    for kind, lines in OTHERS.items():
        for line in lines.splitlines():
            variant, code, file, dim = (x.strip() for x in line.split("|"))
            found.append(ModelInfo(kind, variant, code, None if file == "-" else file, None if dim == "-" else int(dim), POOLING.get(kind), "dynamic" if kind == "joint" else "none", None))
    return found


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.kind, m.variant, m.code, m.file, m.dimension, m.pooling, m.quantization, m.output_key) for m in registry()], SCHEMA)


def get_model(kind: str, name: str) -> ModelInfo:
    """Dense models go by variant, the others by code, both without regard to case."""
    for m in registry():
        if m.kind == kind and (m.variant if kind == "dense" else m.code).lower() == name.lower():
            return m
    raise ValueError(f"unknown {kind} model {name!r}")


def served(registered: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Rows of what is served: each model (id, name, kind, dimension, max_sequence_length, tokenizer, available) with whether
    its tokenizer is available, then each tokenizer (name, available) that no model claims."""
    have = tokenizers.select(F.col("name").alias("_t"), F.col("available").alias("tokenizer_available"))
    rows = registered.join(F.broadcast(have), F.col("tokenizer") == F.col("_t"), "left").drop("_t")
    alone = tokenizers.join(registered.select("tokenizer"), F.col("name") == F.col("tokenizer"), "left_anti")
    null = lambda t: F.lit(None).cast(t)
    extra = alone.select(F.col("name").alias("id"), "name", F.lit("tokenizer").alias("kind"), null("int").alias("dimension"), null("int").alias("max_sequence_length"), F.col("name").alias("tokenizer"), "available", F.col("available").alias("tokenizer_available"))
    return rows.select("id", "name", "kind", "dimension", "max_sequence_length", "tokenizer", "available", "tokenizer_available").union(extra)


#: Settings of an encoder that follow from a model's family, and from the model itself.
HEADS = {"dense": {}, "sparse": {"head": "splade"}, "dual": {"head": "dual"}, "joint": {"head": "joint"}, "rerank": {"head": "rerank"}, "decoder": {"pad_left": True, "inner_epsilon": True}, "moe": {"pooling": "mean_clamped", "inner_epsilon": True}}
OWN = {("sparse", "BGEM3"): {"head": "lexical", "sparse_output": "token_embedding"}, ("dual", "BGEM3"): {"output": "sentence_embedding", "sparse_output": "token_embedding"}}


def decoder_config(text: str) -> dict:
    """A decoder's settings: those of its text part where the file describes more than text."""
    found = json.loads(text)
    if "hidden_size" not in found:
        found = found.get("text_config")
    if not isinstance(found, dict) or "hidden_size" not in found:
        raise ValueError("the configuration describes no decoder of texts")
    return found


# Names of a mixture-of-experts configuration that have another spelling, and what is not stated.
SPELLINGS = {"n_embd": "hidden_size", "n_head": "num_attention_heads", "n_inner": "intermediate_size", "n_layer": "num_hidden_layers", "n_positions": "max_position_embeddings"}
UNSTATED = {"type_vocab_size": 1, "num_experts": 8, "moe_top_k": 2, "moe_every_n_layers": 2, "rotary_emb_base": 10000.0, "rotary_emb_fraction": 1.0, "layer_norm_epsilon": 1e-5, "qkv_proj_bias": True, "mlp_fc1_bias": True, "mlp_fc2_bias": True, "pad_token_id": 1}


def expert_config(text: str) -> dict:
    """A mixture-of-experts model's settings in one spelling, with those that the file does not state; others must be there."""
    raw = json.loads(text)
    found = UNSTATED | {SPELLINGS.get(k, k): v for k, v in raw.items()}
    missing = sorted({*SPELLINGS.values(), "vocab_size"} - found.keys())
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    if len({SPELLINGS.get(k, k) for k in raw}) < len(raw):
        raise ValueError("the configuration states something in two spellings")
    return found


CONFIGS = {"decoder": decoder_config, "moe": expert_config}


def load_from(spark: SparkSession, kind: str, name: str, **settings) -> Encoder:
    """As `load`, with the cache, cap, batch, pinning and providers of the session's settings where none are given."""
    own = Settings.from_session(spark)
    if not own.model_cache:
        raise ValueError("the session states no model_cache")
    return load(kind, name, own.model_cache, **{"max_length": own.max_length, "batch_size": own.max_batch, "pin": own.pin_shapes, "providers": own.providers} | settings)


def load(kind: str, name: str, cache: str, head_weights: str | None = None, ship: bool = False, **settings) -> Encoder:
    """The encoder of a registered model whose files lie in a cache of the hub's layout, with the registry's pooling, output names,
    quantisation and head.

    All files are of one revision, the newest that has them all (numbers beside a model's file are taken where they are there; a
    model that lacks them does not load). A model with a lexical head takes the head's weights from the revision or
    from the file `head_weights`; without either it is an error, never another head. Decoder and mixture-of-experts models have no file
    of their own there: state file=, an ONNX export's; their own configuration must have the registered dimension and bounds the cap,
    and a mixture-of-experts model's states the id of padding.
    ship: the encoder holds the files themselves, for executors that cannot read the cache.
    """
    info = get_model(kind, name)
    if kind not in HEADS:
        raise ValueError(f"{kind} models are not text encoders")
    key = (kind, info.variant)
    file = settings.pop("file", info.file)
    if file is None:
        raise ValueError(f"{info.code} has no registered file; state file=")
    head_file = HEAD_FILES.get(key) if head_weights is None else None
    wanted = (file, "tokenizer.json", *((head_file,) if head_file else ()), *(("config.json",) if kind in CONFIGS else ()))
    found = find_snapshot(cache, info.code, wanted)
    if found is None:
        raise FileNotFoundError(f"{info.code}: no revision under {cache} has all of {', '.join(wanted)}")
    where = Path(found)
    beside = [b for b in BESIDE.get(key, ()) if file == info.file and (where / b).is_file()]
    chosen = {"pooling": info.pooling} if info.pooling else {}
    chosen |= {"output": info.output_key, "quantization": info.quantization} | HEADS[kind] | OWN.get(key, {})
    if key in HEAD_FILES:
        chosen["weight"], chosen["bias"] = read_head(head_weights or str(where / head_file))
        if info.dimension is not None and "weight" not in settings and len(chosen["weight"]) != settings.pop("dimension", info.dimension):
            raise ValueError(f"{info.code}: the head has {len(chosen['weight'])} weights for {info.dimension} dimensions")
    if kind in CONFIGS:
        config = CONFIGS[kind]((where / "config.json").read_text("utf-8"))
        if config["hidden_size"] != settings.pop("dimension", info.dimension):
            raise ValueError(f"{info.code}: {config['hidden_size']} dimensions, and not the {info.dimension} that are registered")
        if "max_position_embeddings" in config:
            chosen["max_length"] = min(settings.pop("max_length", DEFAULT_LENGTH), config["max_position_embeddings"])
        if kind == "moe":
            chosen["pad_id"] = config["pad_token_id"]
    settings.pop("dimension", None)
    made = Encoder(**{"model": str(where / file), "tokenizer": str(where), **chosen, **settings})
    if not ship:
        return made
    tokenizer = load_tokenizer(made.tokenizer, made.max_length, made.pad_left).to_str()
    return replace(made, model=(where / file).read_bytes(), tokenizer=tokenizer, external=tuple((Path(b).name, (where / b).read_bytes()) for b in beside))
