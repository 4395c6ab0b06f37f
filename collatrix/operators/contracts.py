"""Checks that a dataset must pass; a failed one raises when its DataFrame is run, or at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A dataset breaks a rule that the operators rely on."""


def expect(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, which raises as soon as a row breaks the condition is read."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def expect_unique(df: DataFrame, keys: Sequence[str], message: str) -> None:
    """Raise if a key repeats; one aggregate."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ContractError(message)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def expect_same_keys(left: DataFrame, right: DataFrame, key: str, message: str) -> None:
    """Raise unless both sides have the same set of keys."""
    if missing_keys(left, right, key).limit(1).count() or missing_keys(right, left, key).limit(1).count():
        raise ContractError(message)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which no key may repeat on either side."""
    expect_unique(left, keys, f"left side repeats a key of {list(keys)}")
    return join_many_to_one(left, right, keys, how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which no key may repeat on the right side."""
    expect_unique(right, keys, f"right side repeats a key of {list(keys)}")
    return left.join(right, list(keys), how)


def join_all_matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A many-to-one join that raises if a left row has no partner."""
    marked = right.withColumn("_matched", F.lit(True))
    return expect(join_many_to_one(left, marked, keys, "left"), F.col("_matched"), f"a row has no partner by {list(keys)}").drop("_matched")


def expect_one_of(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """``df``, which raises as soon as a value outside ``allowed`` is read; null is outside."""
    return expect(df, F.col(column).isin(*allowed), f"{column} is one of {', '.join(allowed)}")


def reverify(golden: DataFrame, found: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, golden, found, verdict) of recorded values against recomputed ones: same, differs, missing or unexpected. NaN is the same as NaN."""
    both = golden.select(*keys, F.col(value).cast("double").alias("golden"), F.lit(True).alias("_g")).join(found.select(*keys, F.col(value).cast("double").alias("found"), F.lit(True).alias("_f")), list(keys), "full_outer")
    near = F.col("golden").eqNullSafe(F.col("found")) | (F.abs(F.col("golden") - F.col("found")) <= tolerance)
    verdict = F.when(F.col("_f").isNull(), "missing").when(F.col("_g").isNull(), "unexpected").when(F.coalesce(near, F.lit(False)), "same").otherwise("differs")
    return both.select(*keys, "golden", "found", verdict.alias("verdict"))


def drop_and_replace(df: DataFrame, drop: Sequence[str], fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with some columns dropped and those of ``fresh``, one row per key, in their place."""
    return join_many_to_one(df.drop(*drop), fresh, keys)


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str, name: str = "name", value: str = "value") -> DataFrame:
    """The columns whose names start with a prefix, one row each, with the rest of the name."""
    chosen = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(*keys, *[F.col(c).cast("double").alias(c.removeprefix(prefix)) for c in chosen])
    return long.unpivot(list(keys), None, name, value)
