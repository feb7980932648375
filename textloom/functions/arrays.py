"""The same functions over numpy arrays, for use inside vectorised UDFs around a model's forward pass."""

from __future__ import annotations

import numpy as np

from .vectors import MASK_EPSILON, NORM_EPSILON

#: Ids of begin, pad, end and unknown, which a lexical head never keeps.
SPECIAL_IDS = (0, 1, 2, 3)


def l2_normalize(v: np.ndarray, kind: type = np.float32) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / (np.sqrt((v * v).sum(axis=-1, keepdims=True)) + NORM_EPSILON)).astype(kind)


def l2_normalize_inner(v: np.ndarray, kind: type = np.float32) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=-1, keepdims=True) + NORM_EPSILON)).astype(kind)


def check_rank(h: np.ndarray, pooled_ok: bool = True) -> np.ndarray:
    if h.ndim not in ((2, 3) if pooled_ok else (3,)):
        raise ValueError(f"expected an output of rank {'2 or 3' if pooled_ok else '3'}, got {h.ndim}")
    return h


def covers(h: np.ndarray, batch: int, length: int | None) -> np.ndarray:
    """Refuses an output that has fewer rows or positions than went in; it may have more."""
    if h.shape[0] < batch or length is not None and (h.ndim < 3 or h.shape[1] < length):
        raise ValueError(f"the output's shape {h.shape} does not cover {batch} rows" + (f" of {length} positions" if length else ""))
    return h[:batch] if length is None else h[:batch, :length]


def cls_pool(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return h if check_rank(h).ndim == 2 else h[:, 0, :]


def mean_pool(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    if check_rank(h).ndim == 2:
        return h
    m = mask[:, : h.shape[1], None].astype(np.float64)
    count = m.sum(axis=1)
    return (h * m).sum(axis=1) / np.where(count == 0, 1.0, count)


def mean_pool_clamped(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    if check_rank(h).ndim == 2:
        return h
    m = mask[:, : h.shape[1], None].astype(np.float64)
    return (h * m).sum(axis=1) / np.maximum(m.sum(axis=1), MASK_EPSILON)


def last_token_pool(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    if check_rank(h).ndim == 2:
        return h
    on = mask[:, : h.shape[1]] > 0
    at = np.where(on.any(axis=1), on.shape[1] - 1 - on[:, ::-1].argmax(axis=1), h.shape[1] - 1)
    return h[np.arange(len(h)), at]


def last_position_pool(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For inputs that are padded on the left."""
    return h if check_rank(h).ndim == 2 else h[:, -1, :]


POOLING = {"cls": cls_pool, "mean": mean_pool, "mean_clamped": mean_pool_clamped, "last": last_token_pool, "last_position": last_position_pool}


def lexical_head(h: np.ndarray, ids: np.ndarray, mask: np.ndarray, weight: np.ndarray, bias: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row: token ids, ascending, and the largest of relu(h . weight + bias) over each id's positions."""
    if check_rank(h, False).shape[-1] != weight.size:
        raise ValueError(f"a head of {weight.size} weights does not fit {h.shape[-1]} dimensions")
    w = np.maximum(covers(h, *ids.shape) @ weight.reshape(-1) + bias, 0)
    return [max_per_id(ids[i], w[i], mask[i]) for i in range(len(ids))]


def max_per_id(ids: np.ndarray, weights: np.ndarray, mask: np.ndarray, special: tuple[int, ...] = SPECIAL_IDS) -> tuple[np.ndarray, np.ndarray]:
    keep = (mask == 1) & ~np.isin(ids, special) & (weights > 0)
    ids, weights = ids[keep], weights[keep]
    found, at = np.unique(ids, return_inverse=True)
    best = np.zeros(len(found), np.float32)
    np.maximum.at(best, at, weights.astype(np.float32))
    return found, best


def splade_head(logits: np.ndarray, mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row: vocabulary ids, ascending, and the largest ln(1 + relu(logit)) over unmasked positions, if positive."""
    best = (np.log1p(np.maximum(logits, 0)) * mask[:, : logits.shape[1], None]).max(axis=1)
    return [(np.flatnonzero(r > 0), r[r > 0].astype(np.float32)) for r in best]


def multivector_keep(vectors: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """For each row: the vectors of positions after the first whose mask is 1."""
    return [v[m[1 : len(v) + 1] == 1] if len(m) > len(v) else v[: len(m) - 1][m[1:] == 1] for v, m in zip(vectors, mask)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def spans(ids: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """[start, end) of each run of one id."""
    edge = np.diff(np.concatenate(([0], (np.asarray(ids) == wanted).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
