"""Weights of a lexical head from a file of its own: `weight`, a number for each dimension, and `bias`, one number."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np

# The types of numbers that a file of tensors may state, as numpy names them.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4"}


def read_tensors(raw: bytes) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file: the header's length in 8 bytes, the header in JSON, the numbers."""
    if len(raw) < 8 or (size := struct.unpack("<Q", raw[:8])[0]) > len(raw) - 8:
        raise ValueError("this is no file of tensors")
    out = {}
    for name, info in json.loads(raw[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        start, end = info["data_offsets"]
        body = raw[8 + size + start : 8 + size + end]
        if info["dtype"] == "BF16":  # the upper half of a 32-bit float
            flat = (np.frombuffer(body, "<u2").astype(np.uint32) << 16).view(np.float32)
        elif info["dtype"] in KINDS:
            flat = np.frombuffer(body, KINDS[info["dtype"]])
        else:
            raise ValueError(f"{name} has numbers of an unknown type, {info['dtype']}")
        out[name] = flat.reshape(info["shape"])
    return out


def write_tensors(tensors: dict[str, np.ndarray]) -> bytes:
    """The same file, of 32-bit floats."""
    header, body = {}, b""
    for name, x in tensors.items():
        own = np.asarray(x, "<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(np.shape(x)), "data_offsets": [len(body), len(body) + len(own)]}
        body += own
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body


def read_head(path: str) -> tuple[tuple[float, ...], float]:
    """weight and bias of a lexical head, from a file of tensors or of JSON."""
    raw = Path(path).read_bytes()
    try:
        found = json.loads(raw) if path.endswith(".json") else read_tensors(raw)
        weight = np.array(found["weight"], np.float32).reshape(-1)
        bias = np.array(found.get("bias", 0.0), np.float32).reshape(-1)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{path}: no weights of a head ({e})") from None
    if not len(weight) or len(bias) != 1 or not (np.isfinite(weight).all() and np.isfinite(bias).all()):
        raise ValueError(f"{path}: a head has a finite weight for each dimension and one bias")
    return tuple(weight.tolist()), float(bias[0])
