"""Content-defined chunks of byte strings: every window of `width` bytes belongs to the chunk of its minimiser.

The minimiser of a window is the place of the smallest hash among its grams of GRAM bytes, the leftmost if several are
equal. It depends on nothing but the window's bytes, so equal windows, wherever they are, have equal minimisers at equal
offsets.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on."""
    h = flat.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        n = len(h) - step
        if n <= 0:
            return np.zeros(0, np.uint64)
        low = h[:n] * _A
        low ^= low >> np.uint64(31)
        h = low + h[step:] * _B
        step *= 2
    return mix(h)


def content_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each range of GRAM bytes or more, from the hashes of the grams that cover it."""
    out = size.astype(np.uint64) * _B + np.uint64(seed)
    for k in range(0, int(size.max(initial=GRAM)) - GRAM + 1, GRAM):
        out = mix((out ^ h[start + np.minimum(k, size - GRAM)]) * _A)
    return mix((out ^ h[start + size - GRAM]) * _A)


def chunks(texts: list[bytes], width: int, batch: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """For each chunk, in order: text, minimiser's hash, hash of all its bytes, first window, number of windows.

    Places are in the concatenated texts. Texts of fewer than `width` bytes have no windows and no chunks.
    """
    out, at, base, i = [], 0, 0, 0
    while i < len(texts):
        size, k = 0, i
        while k < len(texts) and (k == i or size + len(texts[k]) <= batch):
            size += len(texts[k])
            k += 1
        text, h, c, first, count = _chunks(texts[i:k], width)
        out.append((text + i, h, c, first + base, count))
        base, i = base + size, k
    if not out:
        out = [_chunks([], width)]
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunks(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if len(flat) < width:
        return none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    h = gram_hashes(flat)
    bits = np.uint64(max(1, int(len(flat)).bit_length()))
    order = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = width - GRAM + 1
    low, step = order, 1
    while 2 * step <= span:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.maximum(sizes - width + 1, 0)
    live = np.flatnonzero(windows)
    ok = np.zeros(len(at) + 1, np.int32)
    np.add.at(ok, begins[live], 1)
    np.add.at(ok, begins[live] + windows[live], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(starts):
        return none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    at = at[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(first, len(starts)))
    # texts without bytes share their begin with the next one; the last of them is the one with bytes
    text = np.searchsorted(begins, starts[first], side="right") - 1
    return text, h[at[first]], content_hashes(h, starts[first], count + width - 1), starts[first], count
