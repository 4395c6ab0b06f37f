"""Regions of photos: greedy suppression of overlaps, and which region holds which."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap(a: str, b: str) -> Column:
    """Area that two boxes, structs of x0, y0, x1 and y1, have in common."""
    wide = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    high = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def suppress(regions: DataFrame, iou: float = 0.85, inside: float = 0.95, ratio: float = 0.8) -> DataFrame:
    """(photo, region, kept, reason) of (photo, region, score, x0, y0, x1, y1): greedy, the best score first.

    A region goes if a kept one has ``iou`` with it, or holds ``inside`` of it and is about
    as large. The order decides, so a photo is one row; its regions are few by nature.
    """

    @F.pandas_udf("array<struct<region: long, kept: boolean, reason: string>>")
    def run(photos: pd.Series) -> pd.Series:
        return pd.Series([choose([(r["region"], r["score"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in own]) for own in photos])

    def choose(own: list[tuple]) -> list[tuple]:
        size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        kept, out = [], []
        for r in sorted(own, key=lambda r: (-r[1], -size(r), r[0])):
            why = []
            for k in kept:
                common = max(0.0, min(r[4], k[4]) - max(r[2], k[2])) * max(0.0, min(r[5], k[5]) - max(r[3], k[3]))
                small, large = sorted((size(r), size(k)))
                if common >= iou * (small + large - common):
                    why.append("iou")
                if common > inside * small and small > ratio * large:
                    why.append("containment")
                if why:
                    break
            if not why:
                kept.append(r)
            out.append((r[0], not why, "+".join(why)))
        return out

    rows = regions.groupBy("photo").agg(F.collect_list(F.struct("region", "score", "x0", "y0", "x1", "y1")).alias("all"))
    return rows.select("photo", F.explode(run("all")).alias("x")).select("photo", "x.*")


def holders(regions: DataFrame, inside: float = 0.9, ratio: float = 0.8) -> DataFrame:
    """(photo, region, holder): the smallest region of a photo that holds ``inside`` of another and is larger."""
    box = F.struct("x0", "y0", "x1", "y1")
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    r = regions.select("photo", "region", box.alias("box"), size.alias("size"))
    a = r.select("photo", "region", F.col("box").alias("a"), F.col("size").alias("sa"))
    b = r.select("photo", F.col("region").alias("holder"), F.col("box").alias("b"), F.col("size").alias("sb"))
    pairs = a.join(b, "photo").where("region <> holder AND sb > sa").where((overlap("a", "b") >= inside * F.col("sa")) & (F.col("sa") <= ratio * F.col("sb")))
    first = F.row_number().over(W.partitionBy("photo", "region").orderBy("sb", "holder"))
    return pairs.withColumn("n", first).where("n = 1").select("photo", "region", "holder")
