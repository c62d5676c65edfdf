"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, shared_folder, stored, until_end  # noqa: F401

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


#: Rows of an Arrow batch: a thousand texts are a few megabytes, ten thousand (Spark's default) are a hundred,
#: of which each task holds several copies beside its Python worker's own.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_held: dict[str, Callable[[], None]] = {}


def remember(name: str, clear: Callable[[], None]) -> None:
    """Tell what a Python worker keeps between tasks, and how to let go of it."""
    _held[name] = clear


def alone(name: str = "") -> None:
    """Let go of what other operators have kept in this Python worker, and give the memory back."""
    for other, clear in _held.items():
        if other != name:
            clear()
    give_back()


def give_back() -> None:
    """Give memory that nothing uses any more back to the system; Arrow's pool and the C library hold it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
