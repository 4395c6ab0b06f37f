"""Models as queries: folds by group, feature pipelines, pair classifiers and nulls. Their numbers have no SQL; tests hold the operators against plain versions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.operators import models as M
from collatrix.plans.evaluate import predictions
from collatrix.plans.registry import query
from collatrix.plans.vectors import items

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, x0 to x3, target): features of labelled documents."""
    p = predictions(spark, sf_dir)
    return p.select("doc_id", "source", F.log1p("score").alias("x0"), F.log1p("score_b").alias("x1"), (F.col("doc_id") % 7).cast("double").alias("x2"), F.lit(1.0).alias("x3"), "target")


@query("feature_pipeline")
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without what does not vary, scaled and reduced: variance per dimension."""
    from pyspark.ml.functions import vector_to_array

    rows = labelled(spark, sf_dir)
    out = Pipeline(stages=M.pipeline_stages(["x0", "x1", "x2", "x3"], 2)).fit(rows).transform(rows)
    flat = out.select(F.posexplode(vector_to_array("features")).alias("dimension", "v"))
    return flat.groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.var_samp("v"), 6).alias("variance"))


@query("grouped_cross_validation")
def grouped_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the curve of left-out sources, per strength of the penalty, the best first."""
    rows = labelled(spark, sf_dir)
    featured = Pipeline(stages=M.pipeline_stages(["x0", "x1", "x2", "x3"], 2)).fit(rows).transform(rows).select("source", "target", "features")
    return spark.createDataFrame(M.cross_validate(featured, "target", "source", (0.01, 0.1), 3), "strength double, auc double")


@query("pair_reranker")
def pair_reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a classifier of pairs in which both classes weigh the same."""
    model = M.pair_classifier(labelled(spark, sf_dir), ["x0", "x1"], "target")
    return spark.createDataFrame([(n, float(c)) for n, c in zip(("x0", "x1", "intercept"), [*model.coefficients, model.intercept], strict=True)], "name string, weight double")


@query("permutation_null")
def permutation_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosines of a regression between two halves of vectors after shuffling its targets."""
    rows = items(spark, sf_dir).select("id", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))
    null = M.permutation_null(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), "x", "y", "id", 1.0, 5)
    return spark.createDataFrame(list(enumerate(null)), "draw int, cosine double")


@query("bootstrap_mean_ci")
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score per language with the central 95 % of resampled means."""
    return M.bootstrap_mean(predictions(spark, sf_dir), "score", "lang", "doc_id", 200)
