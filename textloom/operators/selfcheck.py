"""Self-checks: an encoder is trusted if its vector of a fixed text is close to a stored one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.vectors import read_vector, write_vector

# The two bars, and how often a check may be tried.
SERVING, VERIFIED, ATTEMPTS = 0.99, 0.999, 3
TEXT = "A short sentence, always the same, by which an encoder is checked."
SCHEMA = "cosine double, serving boolean, verified boolean, attempts int, error string"


@dataclass(frozen=True)
class Status:
    cosine: float | None
    serving: bool
    verified: bool
    attempts: int
    error: str | None = None


def strict_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if len(a) != len(b) or not len(a):
        return -1.0
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return -1.0 if length == 0 else float(a @ b / length)


def check(embed: Callable[[str], np.ndarray], reference: np.ndarray | None, attempts: int = ATTEMPTS, text: str = TEXT) -> Status:
    """Tries until the cosine reaches SERVING. A check that could not be made has an unknown cosine, not a low one."""
    if reference is None:
        return Status(None, False, False, 0, "there is no reference vector")
    best, error = None, None
    for k in range(1, attempts + 1):
        try:
            score = strict_cosine(embed(text), reference)
        except Exception as e:
            error = str(e)
            continue
        best, error = score if best is None else max(best, score), None
        if score >= SERVING:
            return Status(score, True, score >= VERIFIED, k)
    return Status(best, False, False, attempts, error or "below the bar")


def check_file(embed: Callable[[str], np.ndarray], path: str) -> Status:
    try:
        return check(embed, read_vector(path))
    except (OSError, ValueError) as e:
        return Status(None, False, False, 0, str(e))


def regenerate(embed: Callable[[str], np.ndarray], path: str, confirmed: bool = False) -> dict[str, float | int | None]:
    """Writes a new reference vector, after a report of how it differs from the old one; only on confirmation."""
    new = np.asarray(embed(TEXT), np.float32)
    try:
        old = read_vector(path)
        drift = np.abs(new - old) if len(old) == len(new) else None
        report = {"cosine": strict_cosine(new, old), "differ": None if drift is None else int((drift > 0).sum()), "most": None if drift is None else float(drift.max()), "mean": None if drift is None else float(drift.mean())}
    except (OSError, ValueError):
        report = {"cosine": None, "differ": None, "most": None, "mean": None}
    if confirmed:
        write_vector(path, new)
    return report


def frame(spark: SparkSession, status: Status) -> DataFrame:
    return spark.createDataFrame([(status.cosine, status.serving, status.verified, status.attempts, status.error)], SCHEMA)
