"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, scratch_dir  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bounded_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """Ask for Arrow batches that stay small even when texts are long; sessions with a lower setting keep theirs."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def worker_table(name: str, make):
    """A table that this Python worker keeps from task to task; it holds one such table at a time.

    Workers live through all stages of a job, so a table that an earlier stage filled is freed first and its memory given back.
    """
    import ctypes
    import gc
    import sys
    import types

    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if getattr(kept, "name", None) != name:
        kept.name = kept.table = None
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        kept.table, kept.name = make(), name
    return kept.table


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; the usual held-out split."""
    return F.crc32(key.cast("string").cast("binary")) % n


def pages_of(rows: Iterator, size: int) -> Iterator[list]:
    """Rows in lists of at most ``size``."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held
