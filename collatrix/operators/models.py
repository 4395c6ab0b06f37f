"""Models on grouped data: features of groups per item, grouped cross-validation, pair classifiers, permutation nulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.functions.scalar import dot
from collatrix.operators.evaluate import draw_weights, normal_equations, ridge_from
from collatrix.operators.ranking import in_order


def group_features(supports: DataFrame) -> DataFrame:
    """(item, grp, presence, share, strength) of (item, grp, strength): in long form, as most are absent.

    share is ln(1 + count) over its sum in the item, or over 1 if that is less.
    """
    n = supports.groupBy("item", "grp").agg(F.count("*").alias("n"), F.greatest(F.max("strength"), F.lit(0.0)).alias("strength"))
    n = n.withColumn("w", F.log1p("n"))
    total = n.groupBy("item").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("total"))
    return n.join(total, "item").select("item", "grp", F.lit(1).alias("presence"), (F.col("w") / F.col("total")).alias("share"), "strength")


def grouped_fold(group: Column, folds: int = 5) -> Column:
    """A fold by a hash of the group, so that no group is in two."""
    return F.pmod(F.xxhash64(group), F.lit(folds))


def pipeline_stages(columns: list[str], dims: int | None = None) -> list:
    """Assemble, drop what does not vary, scale, and perhaps reduce."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), VarianceThresholdSelector(featuresCol="raw", outputCol="kept"), StandardScaler(inputCol="kept", outputCol="scaled", withMean=True)]
    return stages + ([PCA(k=dims, inputCol="scaled", outputCol="features")] if dims else [])


def cross_validate(df: DataFrame, target: str, group: str, strengths: tuple[float, ...] = (0.0, 0.01, 0.1, 1.0), folds: int = 5) -> list[tuple[float, float]]:
    """(strength, area under the curve of scores of the fold left out) of ridge-penalised logistic regressions on ``features``, the best first; ties to the stronger penalty."""
    marked = df.withColumn("fold", grouped_fold(F.col(group), folds)).cache()
    out = []
    for strength in strengths:
        held = None
        for fold in range(folds):
            model = LogisticRegression(labelCol=target, regParam=strength, maxIter=50).fit(marked.where(F.col("fold") != fold))
            scored = model.transform(marked.where(F.col("fold") == fold)).select(target, "rawPrediction")
            held = scored if held is None else held.unionByName(scored)
        out.append((strength, BinaryClassificationEvaluator(labelCol=target).evaluate(held)))
    marked.unpersist()
    return sorted(out, key=lambda x: (-round(x[1], 12), -x[0]))


def pair_classifier(pairs: DataFrame, columns: list[str], target: str):
    """A logistic regression on pair features in which both classes weigh the same."""
    share = pairs.agg(F.avg(F.col(target).cast("double")).alias("p")).first()["p"]
    weighed = pairs.withColumn("w", F.when(F.col(target) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    vectors = weighed.withColumn("features", array_to_vector(F.array(*columns)))
    return LogisticRegression(labelCol=target, weightCol="w", maxIter=50).fit(vectors)


def hard_negatives(ranked: DataFrame, per_query: int = 2) -> DataFrame:
    """The nearest items of other groups for each query of (src, src_group, dst, dst_group, rank)."""
    from collatrix.operators.ingest import top_per_group

    return top_per_group(ranked.where("src_group <> dst_group"), ["src"], ["rank"], per_query, "nth").drop("nth")


def random_partner(df: DataFrame, key: str, group: str) -> DataFrame:
    """(key, partner): for each row one of another group, by a hash that is the same in every run.

    Rows stand in the order of a hash; a row's partner is the next one of another
    group, or the first of all for the last ones.
    """
    from pyspark.sql import Window as W

    hashed = df.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.xxhash64(key).alias("h")).withColumn("slice", F.pmod("h", F.lit(64)))
    order = W.partitionBy("slice").orderBy("h", "key")
    run = F.sum(F.when(F.lag("grp").over(order).eqNullSafe(F.col("grp")), 0).otherwise(1)).over(order)
    runs = hashed.withColumn("run", run)
    heads = runs.groupBy("slice", "run").agg(F.min_by("key", "h").alias("partner"), F.first("grp").alias("head_grp"))
    nxt = heads.select("slice", (F.col("run") - 1).alias("run"), "partner")
    joined = runs.join(nxt, ["slice", "run"], "left")
    spare = runs.groupBy("grp").agg(F.min("key").alias("least"))
    firsts = spare.orderBy("least").limit(2).collect()
    other = F.lit(None)
    for r in firsts:
        other = F.when(~F.col("grp").eqNullSafe(F.lit(r["grp"])), F.lit(r["least"])).otherwise(other)
    return joined.select("key", F.coalesce("partner", other).alias("partner"))


def permuted(df: DataFrame, y: str, key: str, draw: int) -> DataFrame:
    """``df`` with the values of ``y`` dealt anew over its rows, by the order of a hash of the key and the draw: no task holds all rows."""
    numbered = in_order(df, [F.col(key)], rank="_to")
    dealt = in_order(df.select(F.col(key).alias("_k"), F.col(y).alias("_y")), [F.xxhash64("_k", F.lit(draw)), F.col("_k")], rank="_to").drop("_k")
    return numbered.drop(y).join(dealt.withColumnRenamed("_y", y), "_to").drop("_to")


def mean_cosine(test: DataFrame, x: str, y: str, weights: np.ndarray) -> float:
    """Mean cosine of a linear guess and the truth."""
    w = weights[:-1]
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in w.T])
    guess = F.zip_with(F.transform(columns, lambda c: dot(F.col(x), c)), F.array(*[F.lit(float(v)) for v in weights[-1]]), lambda p, q: p + q)
    length = F.greatest(F.sqrt(dot(guess, guess)) * F.sqrt(dot(F.col(y), F.col(y))), F.lit(1e-12))
    return test.agg(F.avg(dot(guess, F.col(y)) / length).alias("c")).first()["c"]


def permutation_null(train: DataFrame, test: DataFrame, x: str, y: str, key: str, alpha: float, draws: int = 50, seed: int = 0) -> list[float]:
    """Mean cosines of a ridge regression on held-out rows after shuffling the training targets, a draw each."""
    return [mean_cosine(test, x, y, ridge_from(normal_equations(permuted(train, y, key, seed + draw), x, y), alpha)) for draw in range(draws)]


def bootstrap_mean(df: DataFrame, value: str, by: str, key: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(by, mean, low, high): means and the central 95 % of resampled means.

    A row counts in a draw as often as a Poisson number from a hash of its key says; tasks send sums per group and draw.
    """
    kind = df.schema[by].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.iloc[at : at + 512]
                w = draw_weights(rows["h"].to_numpy(), draws, seed)
                v = rows["v"].to_numpy(dtype=float)
                for g, own in rows.reset_index(drop=True).groupby("g", dropna=False).indices.items():
                    weighed = sums.setdefault(g, np.zeros((2, draws)))
                    weighed += np.stack([v[own] @ w[own], w[own].sum(axis=0)])
        yield pd.DataFrame([(g, x[0], x[1]) for g, x in sums.items()], columns=["g", "total", "weight"])

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        total, weight = (np.stack(pdf[c].to_numpy()).sum(axis=0) for c in ("total", "weight"))
        means = total[weight > 0] / weight[weight > 0]
        return pd.DataFrame({by: [pdf["g"].iloc[0]], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]})

    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h"))
    ends = rows.mapInPandas(add, f"g {kind}, total array<double>, weight array<double>").groupBy("g").applyInPandas(close, f"`{by}` {kind}, low double, high double")
    return df.groupBy(by).agg(F.avg(F.col(value).cast("double")).alias("mean")).join(ends, by).select(by, "mean", "low", "high")
