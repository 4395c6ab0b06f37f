"""What the operators share: the input tables, word patterns and the settings of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.session import materialize, shared_dir

__all__ = ["count_words", "first_by_hash", "documents", "materialize", "read", "release_memory", "released", "released_each", "shared_dir", "small_batches"]

#: A word is a run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def release_memory() -> None:
    """Give what was freed back to the system: Python workers stay for a while after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of a group that gives its memory back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        release_memory()
        return out

    return run


def released_each(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back after the last one."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release_memory()

    return run


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: a batch of very long texts must still fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def count_words(text: Column) -> Column:
    """Words of a text, as a long; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    empty = F.lit("")
    edges = (F.element_at(parts, 1) == empty).cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == empty)).cast("int")
    return (F.size(parts) - edges).cast("long")


def first_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows by a hash of the key, or all: a bounded sample that is the same in every run.

    Rows far beyond the last one wanted are left out before the sort, or else
    every task would send ``most`` rows on.
    """
    n = df.count()
    share = (2 * most + 200) / max(n, 1)
    near = df if share >= 1 else df.where(F.xxhash64(key) < F.lit(int(-(2**63) + share * 2**64)))
    return near.orderBy(F.xxhash64(key), key).limit(most)
