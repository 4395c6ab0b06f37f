"""Review planning: items that add most to the groups seen, each group counting a few times at most."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.session import materialize

#: Items fetched to the driver at a time.
FETCH = 10_000


def gains(incidence: DataFrame, seen: Mapping, weights: DataFrame | None = None, repeats: int = 2) -> DataFrame:
    """(item, gain) of distinct (item, grp): the weights of groups seen fewer than ``repeats`` times, over ``repeats``."""
    spark = incidence.sparkSession
    full = [(g,) for g, n in seen.items() if n >= repeats]
    if full:
        kind = incidence.schema["grp"].dataType.simpleString()
        incidence = incidence.join(F.broadcast(spark.createDataFrame(full, f"grp {kind}")), "grp", "left_anti")
    if weights is None:
        weighed = incidence.withColumn("weight", F.lit(1.0))
    else:
        weighed = incidence.join(weights.select("grp", "weight"), "grp", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return weighed.groupBy("item").agg(F.round(F.sum("weight") / repeats, 12).alias("gain")).where("gain > 0")


def greedy_plan(incidence: DataFrame, budget: int = 25, weights: DataFrame | None = None, repeats: int = 2, reviewed: DataFrame | None = None, fetch: int = FETCH) -> list[tuple]:
    """(rank, item, gain) of the items that add most, one after the other; ties go to the least item.

    Gains never grow, so what an item added at first bounds what it adds later. The
    best ``fetch`` items come to the driver, which picks from them as long as the best
    beats the bound of all others; then gains are computed anew. The driver holds
    ``fetch`` items and the groups of those chosen, whatever the size of the input.
    """
    if not 1 <= budget <= 500 or not 1 <= repeats <= 5:
        raise ValueError("budget is 1 to 500, repeats 1 to 5")
    seen: dict = {}
    if reviewed is not None:
        done = incidence.join(reviewed.select("item").distinct(), "item", "left_semi")
        seen = {r["grp"]: r["n"] for r in done.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        incidence = incidence.join(reviewed.select("item").distinct(), "item", "left_anti")
    incidence = materialize(incidence.select("item", "grp"), "incidence")
    chosen: list[tuple] = []
    spark, kind = incidence.sparkSession, incidence.schema["item"].dataType.simpleString()
    while len(chosen) < budget:
        rest = incidence
        if chosen:
            rest = incidence.join(F.broadcast(spark.createDataFrame([(i,) for _, i, _ in chosen], f"item {kind}")), "item", "left_anti")
        top = gains(rest, seen, weights, repeats).orderBy(F.desc("gain"), "item").limit(fetch + 1).collect()
        if not top:
            break
        bound = (-top[fetch]["gain"], top[fetch]["item"]) if len(top) > fetch else None
        wanted = spark.createDataFrame([(r["item"],) for r in top[:fetch]], f"item {kind}")
        near = rest.join(F.broadcast(wanted), "item", "left_semi")
        near = near.withColumn("weight", F.lit(1.0)) if weights is None else near.join(weights.select("grp", "weight"), "grp", "left")
        groups: dict = {}
        for r in near.orderBy("item", "grp").collect():
            groups.setdefault(r["item"], []).append((r["grp"], 1.0 if r["weight"] is None else r["weight"]))
        value = lambda item: round(sum(w for g, w in groups[item] if seen.get(g, 0) < repeats) / repeats, 12)  # noqa: E731, B023
        heap = [(-r["gain"], r["item"]) for r in top[:fetch]]
        heapq.heapify(heap)
        while heap and len(chosen) < budget:
            old, item = heapq.heappop(heap)
            now = value(item)
            if now <= 0:
                continue
            if -now > old and heap and (-now, item) > heap[0]:
                heapq.heappush(heap, (-now, item))
                continue
            if bound is not None and (-now, item) > bound:
                break
            chosen.append((len(chosen) + 1, item, now))
            for g, _ in groups[item]:
                seen[g] = seen.get(g, 0) + 1
    return chosen


def plan_frame(incidence: DataFrame, **options) -> DataFrame:
    """The greedy plan as a DataFrame (rank, item, gain)."""
    kind = incidence.schema["item"].dataType.simpleString()
    return incidence.sparkSession.createDataFrame(greedy_plan(incidence, **options), f"rank int, item {kind}, gain double")


def static_order(incidence: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(item, utility) by all that an item has, whatever was seen before."""
    return gains(incidence, {}, weights, 1).withColumnRenamed("gain", "utility")


def coverage_at(order: DataFrame, incidence: DataFrame, budgets: DataFrame, repeats: int = 2) -> DataFrame:
    """Per budget of ``budgets`` what the first items of ``order`` (item, rank) cover."""
    taken = order.join(F.broadcast(budgets), F.col("rank") <= F.col("budget"))
    per = taken.join(incidence, "item").groupBy("budget", "grp").agg(F.count("*").alias("n"))
    covered = per.groupBy("budget").agg(
        F.count("*").alias("groups_seen"),
        F.count_if(F.col("n") >= repeats).alias("groups_repeated"),
        F.round(F.sum(F.least("n", F.lit(repeats)) / F.lit(float(repeats))), 9).alias("weighted_coverage"),
    )
    items = taken.groupBy("budget").agg(F.count("*").alias("items"))
    return budgets.join(items, "budget", "left").join(covered, "budget", "left").na.fill(0)
