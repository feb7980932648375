"""Sessions with the settings that the operators expect, and this package on the executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once an application, so that they need no path to it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)


def ship_active() -> None:
    """The same for the session that is active, if there is one: for operators that get columns only."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches of this session hold `most` bytes at most; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    m = re.fullmatch(r"(\d+)([bkmg]?)b?", str(spark.conf.get(key, "64m")).lower())
    if m is None or int(m[1]) * units[m[2] or "b"] > most or int(m[1]) <= 0:
        spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system; workers are kept between tasks, and so would be what they once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
