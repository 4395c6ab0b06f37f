"""Evaluation: ranking metrics, thresholds, strata and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.ranking import in_order


def auc(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums, ties counting half; null where a class is empty.

    Ranks come from counts per distinct score, so what is sorted in one place is scores, not rows.
    """
    by = by or []
    at = df.groupBy(*by, score).agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = at.select(*by, "p", "n", (F.col("p") * (below + F.col("n") / F.lit(2.0))).alias("wins"))
    total = wins.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("wins").alias("wins"))
    pairs = F.col("positives") * F.col("negatives")
    return total.select(*by, "positives", "negatives", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def cumulative(df: DataFrame, score: str, target: str) -> DataFrame:
    """Per distinct score, from the highest: how many positives and rows score that or more, and totals."""
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(target).alias("p"), F.count("*").alias("k"))
    total = df.agg(F.sum(target).alias("positives"), F.count("*").alias("rows"))
    down = in_order(at, [F.desc("threshold")], {"tp": "p", "taken": "k"})
    return down.crossJoin(F.broadcast(total)).select("threshold", "tp", "taken", "positives", "rows")


def rates(c: DataFrame) -> DataFrame:
    """True and false positive rates, precision and balanced accuracy of ``cumulative``."""
    negatives = F.col("rows") - F.col("positives")
    tpr, fpr = F.col("tp") / F.col("positives"), (F.col("taken") - F.col("tp")) / negatives
    return c.select("threshold", "tp", "taken", "positives", tpr.alias("tpr"), fpr.alias("fpr"), (F.col("tp") / F.col("taken")).alias("precision"), ((tpr + 1 - fpr) / 2).alias("balanced"))


def draw_weights(hashes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each draw takes each row: Poisson numbers with mean 1, from a hash of the row and the draw, rows by draws."""
    x = hashes.astype(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    law = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
    return np.searchsorted(law, share.reshape(-1), side="right").reshape(share.shape).astype(np.float64)


def range_sums(draws: int, seed: int):
    """Per model of a range of scores, in order: resampled positives, negatives and pairs that are won, an array over draws each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[str, list[np.ndarray]] = {}
        open_model, open_score, pending = None, None, np.zeros((2, draws))

        def close() -> None:
            if open_model is not None:
                p, n, wins = done.setdefault(open_model, [np.zeros(draws) for _ in range(3)])
                wins += pending[0] * (n + pending[1] / 2)
                p += pending[0]
                n += pending[1]

        part = 0
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.iloc[at : at + 512]
                part = int(rows["part"].iloc[0])
                w = draw_weights(rows["h"].to_numpy(), draws, seed)
                positive = rows["target"].to_numpy() == 1
                new = np.r_[True, (rows["model"].to_numpy()[1:] != rows["model"].to_numpy()[:-1]) | (rows["score"].to_numpy()[1:] != rows["score"].to_numpy()[:-1])]
                starts = np.flatnonzero(new)
                sums = [np.add.reduceat(w * side[:, None], starts, axis=0) for side in (positive, ~positive)]
                for k, start in enumerate(starts):
                    model, score = rows["model"].iloc[start], rows["score"].iloc[start]
                    if (model, score) != (open_model, open_score):
                        close()
                        open_model, open_score, pending = model, score, np.zeros((2, draws))
                    pending[0] += sums[0][k]
                    pending[1] += sums[1][k]
        close()
        yield pd.DataFrame([(part, m, p, n, wins) for m, (p, n, wins) in done.items()], columns=["part", "model", "p", "n", "wins"])

    return run


def bootstrap_auc(df: DataFrame, scores: list[str], target: str, key: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(draw, model, auc): resamples of positives and negatives, the same for all models.

    A row counts in a draw as often as a Poisson number from a hash of its key says. Rows are dealt by ranges of
    the score; a range gives sums per draw, and only these, an array per range and model, are put together.
    """

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        p, n, wins = (np.stack(pdf[c].to_numpy()) for c in ("p", "n", "wins"))
        below = np.cumsum(n, axis=0) - n
        pairs = p.sum(axis=0) * n.sum(axis=0)
        won = (wins + p * below).sum(axis=0)
        out = np.divide(won, pairs, out=np.full(draws, np.nan), where=pairs > 0)
        return pd.DataFrame({"draw": np.arange(draws), "model": pdf["model"].iloc[0], "auc": out})

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("score")) for c in scores])).alias("x")
    long = df.select(F.xxhash64(key).alias("h"), F.col(target).alias("target"), pairs).select("h", "target", "x.model", "x.score")
    ranged = long.where("score IS NOT NULL AND target IS NOT NULL").repartitionByRange("model", "score").sortWithinPartitions("model", "score").withColumn("part", F.spark_partition_id())
    sums = ranged.mapInPandas(range_sums(draws, seed), "part int, model string, p array<double>, n array<double>, wins array<double>")
    return sums.groupBy("model").applyInPandas(add_up, "draw long, model string, auc double")


def paired_delta(draws: DataFrame, better: str, worse: str) -> DataFrame:
    """One row (model, mean, low, high, above): the difference of two models' areas over the same draws, its central 95 %, and the share of draws above 0."""
    wide = draws.groupBy("draw").pivot("model", [better, worse]).agg(F.first("auc"))
    delta = wide.select(F.lit(f"{better} - {worse}").alias("model"), (F.col(f"`{better}`") - F.col(f"`{worse}`")).alias("auc"))
    above = delta.groupBy("model").agg(F.avg((F.col("auc") > 0).cast("double")).alias("above"))
    return interval(delta, "auc", ["model"]).join(above, "model")


def interval(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and the central 95 % of draws."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of a ridge regression with an intercept, from the normal equations."""
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    a = (x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1])
    w = np.linalg.solve(a, (x - xm).T @ (y - ym))
    return np.vstack([w, ym - xm @ w])


def normal_equations(df: DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'Y, sums of X and Y and the number of rows, added up per task: the driver gets one matrix per task, not rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = None
        for batch in batches:
            if len(batch):
                a, b = (np.stack(batch[c].to_numpy()).astype(float) for c in (x, y))
                own = [a.T @ a, a.T @ b, a.sum(axis=0), b.sum(axis=0), np.array([len(a)], dtype=float)]
                parts = own if parts is None else [p + o for p, o in zip(parts, own, strict=True)]
        if parts is not None:
            yield pd.DataFrame({"part": range(5), "data": [p.reshape(-1) for p in parts]})

    long = df.select(x, y).mapInPandas(run, "part int, data array<double>").select("part", F.posexplode("data").alias("i", "v"))
    summed = long.groupBy("part", "i").agg(F.sum("v").alias("v")).orderBy("part", "i").toPandas()
    flat = [g["v"].to_numpy() for _, g in summed.groupby("part")]
    dx, dy = len(flat[2]), len(flat[3])
    return flat[0].reshape(dx, dx), flat[1].reshape(dx, dy), flat[2], flat[3], int(flat[4][0])


def ridge_from(parts: tuple, alpha: float) -> np.ndarray:
    """What ``ridge`` gives, from ``normal_equations``."""
    xx, xy, sx, sy, n = parts
    a = xx - np.outer(sx, sx) / n + alpha * np.eye(len(sx))
    w = np.linalg.solve(a, xy - np.outer(sx, sy) / n)
    return np.vstack([w, sy / n - (sx / n) @ w])


def found_at(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows by score, with their place as ``rank``; ``k`` is what a report shows, so the window is over that many rows."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))
