"""Settings of an encoding job, from the environment or a Spark session; a value that cannot be read is an error."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from . import limits

_TRUE, _FALSE = ("1", "true", "on", "yes"), ("0", "false", "off", "no")


@dataclass(frozen=True)
class Settings:
    """max_length and max_batch of requests that state none; pin shapes; providers in order; where models are cached."""

    max_length: int = limits.DEFAULT_LENGTH
    max_batch: int = limits.DEFAULT_BATCH
    tokenize_rows: int = limits.MOST_TOKENIZE_ROWS
    pin_shapes: bool = False
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    model_cache: str = ""

    @classmethod
    def read(cls, values: Mapping[str, str]) -> Settings:
        """From names like the fields'; names that are missing or empty keep their defaults."""
        found = {}
        for f in fields(cls):
            raw = (values.get(f.name) or "").strip()
            if raw:
                found[f.name] = _read(f.name, raw, f.default)
        return cls(**found)

    @classmethod
    def from_env(cls, prefix: str = "TEXTLOOM_") -> Settings:
        return cls.read({k.removeprefix(prefix).lower(): v for k, v in os.environ.items() if k.startswith(prefix)})

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.textloom.") -> Settings:
        return cls.read({f.name: spark.conf.get(prefix + f.name, "") for f in fields(cls)})


def _read(name: str, raw: str, default: object) -> object:
    try:
        if isinstance(default, bool):
            return {**dict.fromkeys(_TRUE, True), **dict.fromkeys(_FALSE, False)}[raw.lower()]
        if isinstance(default, int):
            if int(raw) < 1:
                raise ValueError
            return int(raw)
    except (KeyError, ValueError):
        raise ValueError(f"{name}: cannot read {raw!r}") from None
    return tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(default, tuple) else raw
