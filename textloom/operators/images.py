"""Image preparation for vision encoders: arrays of rows x columns x 3 in, channels x rows x columns out.

Sizes are (height, width) throughout, also for targets that are not square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.images import decode, to_rgb

_sessions: dict = {}


def _weights(n: int, m: int) -> np.ndarray:
    """m x n weights of a Catmull-Rom resampling from n to m samples; wider where samples are lost."""
    scale = n / m
    support = 2.0 * max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    x = np.abs(np.arange(n)[None, :] - centre[:, None]) / max(scale, 1.0)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    w = np.where(np.abs(np.arange(n)[None, :] - centre[:, None]) <= support, w, 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """To exactly this size."""
    if x.shape[:2] == (height, width):
        return x
    y = np.einsum("hr,rwc->hwc", _weights(x.shape[0], height), x.astype(np.float64))
    y = np.einsum("vw,hwc->hvc", _weights(x.shape[1], width), y)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8)


def center_crop(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The middle; an image that is smaller is filled with zeros around it."""
    out = np.zeros((height, width, x.shape[2]), x.dtype)
    h, w = min(height, x.shape[0]), min(width, x.shape[1])
    top, left = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
    down, right = (height - h) // 2, (width - w) // 2
    out[down : down + h, right : right + w] = x[top : top + h, left : left + w]
    return out


def to_chw(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32).transpose(2, 0, 1)


def rescale(x: np.ndarray, factor: float = 1 / 255) -> np.ndarray:
    return x * np.float32(factor)


def normalize(x: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    if len(mean) != len(x) or len(std) != len(x):
        raise ValueError(f"{len(mean)} means and {len(std)} deviations for {len(x)} channels")
    return (x - np.array(mean, np.float32)[:, None, None]) / np.array(std, np.float32)[:, None, None]


def _size(spec: dict | int) -> tuple[int, int]:
    if isinstance(spec, int):
        return spec, spec
    if "shortest_edge" in spec:
        return int(spec["shortest_edge"]), int(spec["shortest_edge"])
    if "height" in spec and "width" in spec:
        return int(spec["height"]), int(spec["width"])
    raise ValueError(f"no size in {spec}")


def pipeline(config: dict) -> Callable[[np.ndarray], np.ndarray]:
    """The steps of a preprocessor config: CLIP, ViT and ConvNext processors; none stated means CLIP."""
    kind = config.get("image_processor_type", config.get("feature_extractor_type", "CLIPImageProcessor"))
    steps: list[Callable[[np.ndarray], np.ndarray]] = [to_rgb]
    if kind in ("CLIPImageProcessor", "CLIPFeatureExtractor", "ViTImageProcessor", "ViTFeatureExtractor"):
        if config.get("do_resize", kind.startswith("CLIP")):
            h, w = _size(config["size"])
            steps.append(lambda x: resize(x, h, w))
        if config.get("do_center_crop", False):
            ch, cw = _size(config["crop_size"])
            steps.append(lambda x: center_crop(x, ch, cw))
    elif kind in ("ConvNextImageProcessor", "ConvNextFeatureExtractor"):
        edge = _size(config["size"])[0]
        if edge < 384:
            large = int(edge / config.get("crop_pct", 0.875))
            steps += [lambda x: resize(x, large, large), lambda x: center_crop(x, edge, edge)]
        else:
            steps.append(lambda x: resize(x, edge, edge))
    else:
        raise ValueError(f"unknown image processor {kind!r}")
    steps.append(to_chw)
    if config.get("do_rescale", True):
        factor = config.get("rescale_factor", 1 / 255)
        steps.append(lambda x: rescale(x, factor))
    if config.get("do_normalize", False):
        mean, std = config["image_mean"], config["image_std"]
        steps.append(lambda x: normalize(x, mean, std))

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    return run


@dataclass(frozen=True)
class SmartSize:
    """Sizes that are multiples of a factor, within bounds of pixels, close to the image's shape."""

    factor: int = 28
    least: int = 56 * 56
    most: int = 14 * 14 * 4 * 1280
    aspect: int = 200

    def of(self, height: int, width: int) -> tuple[int, int]:
        if min(height, width) < 1 or max(height, width) / min(height, width) > self.aspect:
            raise ValueError(f"an image of {height} x {width} is empty or beyond an aspect of {self.aspect}")
        h, w = (max(self.factor, round(x / self.factor) * self.factor) for x in (height, width))  # ties to even
        if h * w > self.most:
            beta = math.sqrt(height * width / self.most)
            h, w = (max(self.factor, math.floor(x / beta / self.factor) * self.factor) for x in (height, width))
        elif h * w < self.least:
            beta = math.sqrt(self.least / (height * width))
            h, w = (math.ceil(x * beta / self.factor) * self.factor for x in (height, width))
        return h, w


def patchify(x: np.ndarray, patch: int = 14, merge: int = 2, frames: int = 2) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Patches as rows, those of a merge x merge block together, and the grid (time, rows, columns). x: channels first."""
    c, h, w = x.shape
    gh, gw = h // patch, w // patch
    if h % (patch * merge) or w % (patch * merge):
        raise ValueError(f"{h} x {w} is not made of blocks of {patch * merge}")
    y = np.broadcast_to(x, (frames, c, h, w)).reshape(frames, c, gh // merge, merge, patch, gw // merge, merge, patch)
    return y.transpose(2, 5, 3, 6, 1, 0, 4, 7).reshape(gh * gw, c * frames * patch * patch), (1, gh, gw)


def position_ids(grid: tuple[int, int, int], merge: int = 2) -> np.ndarray:
    """Row and column of each patch, in the order of patchify."""
    t, h, w = grid
    at = np.stack(np.meshgrid(np.arange(h), np.arange(w), indexing="ij"), axis=-1)
    at = at.reshape(h // merge, merge, w // merge, merge, 2).transpose(0, 2, 1, 3, 4).reshape(-1, 2)
    return np.tile(at, (t, 1))


def onnx_runner(model: str | bytes, output: str | None = None, threads: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """What embed_images runs for an ONNX model with one input: the named output, or the one that encode.select_output takes. The
    session is built once a worker."""
    key = model if isinstance(model, str) else hashlib.blake2b(model).digest()

    def run(batch: np.ndarray) -> np.ndarray:
        import onnxruntime as ort

        from .encode import select_output

        if key not in _sessions:
            options = ort.SessionOptions()
            options.intra_op_num_threads = threads
            _sessions.clear()  # one model at a time
            _sessions[key] = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        session = _sessions[key]
        found = dict(zip([o.name for o in session.get_outputs()], session.run(None, {session.get_inputs()[0].name: batch.astype(np.float32)})))
        return select_output({"text_embeds" if n == "image_embeds" else n: v for n, v in found.items()}, "text_embeds" if output == "image_embeds" else output)

    return run


def load_image_model(name: str, cache: str) -> tuple[dict, Callable[[np.ndarray], np.ndarray]]:
    """The preparation settings and the runner of a registered image model whose files lie in a cache of the hub's layout."""
    import json

    from ..sources.tokenizer_files import find_in_cache
    from .models import get_model

    info = get_model("image", name)
    found = find_in_cache(cache, info.code, info.file), find_in_cache(cache, info.code, "preprocessor_config.json")
    if None in found:
        raise FileNotFoundError(f"{info.code}: no {info.file} with preprocessor_config.json under {cache}")
    with open(found[1], encoding="utf-8") as f:
        return json.load(f), onnx_runner(found[0], info.output_key)


def embed_images(df: DataFrame, config: dict, run_batch: Callable[[np.ndarray], np.ndarray], content: str = "content", out: str = "embedding", batch_size: int = 32) -> DataFrame:
    """Adds the vector of each image; run_batch maps a stack of prepared images to one row each (rank 3: its first token)."""

    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ..functions.arrays import cls_pool, l2_normalize

        prepare = pipeline(config)
        for raw in batches:
            rows: list[np.ndarray | None] = [None] * len(raw)
            at = [i for i, r in enumerate(raw) if r is not None]
            for s in range(0, len(at), batch_size):
                part = at[s : s + batch_size]
                got = run_batch(np.stack([prepare(decode(bytes(raw.iloc[i]))) for i in part]))
                if len(got) < len(part):
                    raise ValueError(f"{len(got)} rows for {len(part)} images")
                for i, v in zip(part, l2_normalize(cls_pool(got[: len(part)], np.zeros((len(part), 1))))):
                    rows[i] = v
            yield pd.Series(rows)

    return df.withColumn(out, embed(F.col(content)))
