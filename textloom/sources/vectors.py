"""Reference vectors: a file of little-endian 32-bit floats without header; its size is the dimension."""

from __future__ import annotations

import numpy as np


def read_vector(path: str) -> np.ndarray:
    raw = open(path, "rb").read()
    if not raw or len(raw) % 4:
        raise ValueError(f"{path}: {len(raw)} bytes are not a row of 32-bit floats")
    return np.frombuffer(raw, "<f4").copy()


def write_vector(path: str, v: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(np.asarray(v, "<f4").tobytes())
