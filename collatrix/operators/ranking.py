"""Row numbers and running sums over a whole dataset's order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.session import materialize


def in_order(df: DataFrame, order: Sequence[Column | str], running: Mapping[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (row numbers from 1) and ``running`` ({new column: summed column}) over a total order.

    Rows are dealt by ranges of the order and written once; each range has its own
    window, and the totals of the ranges before it, a row per range, are added.
    """
    running = dict(running or {})
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = [F.sum(c).alias(f"_sum_{i}") for i, c in enumerate(running.values())]
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), *sums)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in totals.columns if c != "_range"])
    local = W.partitionBy("_range").orderBy(*order)
    until = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ranged.join(F.broadcast(offsets), "_range")
    out = joined.select(
        "*",
        *([(F.row_number().over(local) + F.col("_rows_before")).alias(rank)] if rank else []),
        *[(F.sum(c).over(until) + F.col(f"_sum_{i}_before")).alias(name) for i, (name, c) in enumerate(running.items())],
    )
    return out.drop("_range", *[c for c in offsets.columns])


def competition_rank(df: DataFrame, score: str, place: str = "place") -> DataFrame:
    """(score, place) per distinct score: one more than the number of rows that score higher."""
    counted = df.groupBy(score).agg(F.count("*").alias("_n"))
    ordered = in_order(counted, [F.desc(score)], running={"_until": "_n"})
    return ordered.select(score, (F.col("_until") - F.col("_n") + 1).alias(place))
