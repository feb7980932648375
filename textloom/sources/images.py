"""Images from paths or bytes, decoded without other libraries: PNG (8 bits, not interlaced) and binary PPM and PGM.

Other formats are decoded where Pillow is installed.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and content of each file."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def decode(raw: bytes) -> np.ndarray:
    """Rows x columns x 3, unsigned bytes; the format is told by the content."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(raw)
    if raw[:2] in (b"P6", b"P5"):
        return _pnm(raw)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("not a PNG, PPM or PGM image, and Pillow is not installed") from None
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


def to_rgb(x: np.ndarray) -> np.ndarray:
    """Grey becomes three equal channels; alpha goes."""
    if x.ndim == 2:
        x = x[:, :, None]
    return np.repeat(x[:, :, :1], 3, axis=2) if x.shape[2] < 3 else x[:, :, :3]


def _pnm(raw: bytes) -> np.ndarray:
    m = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", raw)
    if not m or int(m[4]) != 255:
        raise ValueError("not a PPM or PGM image of 8 bits")
    w, h, c = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    return to_rgb(np.frombuffer(raw, np.uint8, w * h * c, m.end()).reshape(h, w, c))


def _png(raw: bytes) -> np.ndarray:
    at, body, head, palette = 8, b"", None, None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += data
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only PNG images of 8 bits that are not interlaced are decoded")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                up, corner = above[x], above[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if da <= db and da <= dc else up if db <= dc else corner
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    out = out.reshape(h, w, channels)
    return palette[out[:, :, 0]] if head[3] == 3 else to_rgb(out if channels != 2 else out[:, :, :1])
