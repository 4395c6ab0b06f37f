"""Evaluation queries: a document's length is the score, its label the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.evaluate import auc, bootstrap_auc, cumulative, interval, normal_equations, paired_delta, rates, ridge_from
from collatrix.operators.ranking import in_order
from collatrix.plans.registry import query
from collatrix.plans.vectors import items
from collatrix.sources.tables import table

PREDS_SQL = "preds AS (SELECT doc_id, lang, source, n_chars::DOUBLE AS score, length(text)::DOUBLE / (1 + (doc_id % 7)) AS score_b, quality AS target, toxic FROM documents JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, score, score_b, target, toxic)."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"), (F.length("text").cast("double") / (1 + F.col("doc_id") % 7)).alias("score_b"))
    return scored.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target"), "toxic"), "doc_id")


PAIRS_SQL = "sum((x.score > y.score)::INT + 0.5::DOUBLE * (x.score = y.score)::INT)"


@query(
    "auc_by_score",
    f"""WITH {PREDS_SQL}, long AS (UNPIVOT (SELECT doc_id, target, score, score_b FROM preds) ON score, score_b INTO NAME model VALUE s)
    SELECT x.model, round(sum((x.s > y.s)::INT + 0.5::DOUBLE * (x.s = y.s)::INT) / count(*), 9) AS auc, count(DISTINCT x.doc_id) AS positives
    FROM long x JOIN long y ON x.model = y.model AND x.target = 1 AND y.target = 0 GROUP BY x.model""",
)
def auc_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve of two scores, unpivoted to rows."""
    long = predictions(spark, sf_dir).unpivot(["doc_id", "target"], ["score", "score_b"], "model", "s")
    return auc(long, "s", "target", ["model"]).select("model", F.round("auc", 9).alias("auc"), "positives")


@query(
    "conditional_auc",
    f"""WITH {PREDS_SQL}, s AS (SELECT x.lang, {PAIRS_SQL} AS wins, count(*) AS pairs FROM preds x JOIN preds y ON x.lang = y.lang AND x.target = 1 AND y.target = 0 GROUP BY x.lang)
    SELECT round(sum(wins) / sum(pairs), 9) AS auc, sum(pairs)::BIGINT AS pairs, count(*) AS strata FROM s""",
)
def conditional_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve over pairs of the same language; strata of one class count nothing."""
    s = auc(predictions(spark, sf_dir), "score", "target", ["lang"]).withColumn("pairs", F.col("positives") * F.col("negatives")).where("pairs > 0")
    return s.agg(F.round(F.sum(F.col("auc") * F.col("pairs")) / F.sum("pairs"), 9).alias("auc"), F.sum("pairs").alias("pairs"), F.count("*").alias("strata"))


@query(
    "topk_found",
    f"""WITH {PREDS_SQL}, r AS (SELECT lang, target, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM preds)
    SELECT lang, count(*) AS k, sum(target)::BIGINT AS found, round(avg(target), 9) AS precision FROM r WHERE rank <= 10 GROUP BY lang""",
)
def topk_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives among the ten best of each language."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    top = predictions(spark, sf_dir).withColumn("rank", rank).where("rank <= 10")
    return top.groupBy("lang").agg(F.count("*").alias("k"), F.sum("target").alias("found"), F.round(F.avg("target"), 9).alias("precision"))


CUM_SQL = f"""{PREDS_SQL}, cuts AS (SELECT score AS threshold, sum(target) AS p, count(*) AS k FROM preds GROUP BY score),
    c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(k) OVER (ORDER BY threshold DESC) AS taken, sum(p) OVER () AS positives, sum(k) OVER () AS total FROM cuts),
    rates AS (SELECT threshold, tp, taken, tp / positives AS tpr, (taken - tp) / (total - positives) AS fpr, tp / taken AS precision FROM c)"""


@query("roc_points", f"WITH {CUM_SQL} SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM rates")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC curve at each distinct score."""
    return rates(cumulative(predictions(spark, sf_dir), "score", "target")).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(
    "threshold_balanced",
    f"""WITH {CUM_SQL} SELECT threshold, round((tpr + 1 - fpr) / 2, 9) AS balanced FROM rates ORDER BY round((tpr + 1 - fpr) / 2, 9) DESC, abs(threshold - 1500), threshold LIMIT 1""",
)
def threshold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the greatest balanced accuracy; ties to the nearest to the middle, then the least."""
    r = rates(cumulative(predictions(spark, sf_dir), "score", "target")).select("threshold", F.round("balanced", 9).alias("balanced"))
    return r.orderBy(F.desc("balanced"), F.abs(F.col("threshold") - 1500), "threshold").limit(1)


@query(
    "threshold_precision_floor",
    f"""WITH {CUM_SQL}, ok AS (SELECT threshold, taken, precision FROM rates WHERE precision >= 0.87 ORDER BY taken DESC, threshold LIMIT 1)
    SELECT coalesce((SELECT threshold FROM ok), 1e9) AS threshold, coalesce((SELECT taken FROM ok), 0)::BIGINT AS emitted, (SELECT round(precision, 9) FROM ok) AS precision""",
)
def threshold_precision_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that lets most rows through at a precision of 0.87 or more; if none does, nothing passes."""
    r = rates(cumulative(predictions(spark, sf_dir), "score", "target")).where("precision >= 0.87")
    best = r.agg(F.max(F.struct("taken", (-F.col("threshold")).alias("t"), "precision")).alias("x"))
    return best.select(F.coalesce(-F.col("x.t"), F.lit(1e9)).alias("threshold"), F.coalesce("x.taken", F.lit(0)).alias("emitted"), F.round("x.precision", 9).alias("precision"))


@query(
    "average_precision_brier",
    f"""WITH {CUM_SQL}, steps AS (SELECT precision * (tpr - coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0)) AS part FROM rates)
    SELECT round((SELECT sum(part) FROM steps), 9) AS average_precision, round(avg((least(1, score / 5000) - target) ** 2), 9) AS brier,
    round(avg(CASE WHEN (score >= 1500)::INT = target THEN 1 ELSE 0 END), 9) AS accuracy FROM preds""",
)
def average_precision_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision, Brier score and accuracy."""
    preds = predictions(spark, sf_dir)
    r = rates(cumulative(preds, "score", "target"))
    # What a threshold adds to the true positives is what scores that alone.
    own = preds.groupBy(F.col("score").alias("threshold")).agg(F.sum("target").alias("own"))
    ap = r.join(own, "threshold").select((F.col("precision") * F.col("own") / F.col("positives")).alias("part")).agg(F.round(F.sum("part"), 9).alias("average_precision"))
    right = ((F.col("score") >= 1500).cast("int") == F.col("target")).cast("double")
    rest = preds.agg(F.round(F.avg((F.least(F.lit(1.0), F.col("score") / 5000) - F.col("target")) ** 2), 9).alias("brier"), F.round(F.avg(right), 9).alias("accuracy"))
    return ap.crossJoin(rest)


@query(
    "discovery_curve",
    f"""WITH {PREDS_SQL} SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, sum(target) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS found
    FROM preds QUALIFY rank <= 100""",
)
def discovery_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives found along the first hundred of the ranking."""
    top = predictions(spark, sf_dir).select("doc_id", "score", "target").orderBy(F.desc("score"), "doc_id").limit(100)
    order = W.orderBy(F.desc("score"), "doc_id")
    return top.select(F.row_number().over(order).alias("rank"), F.sum("target").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("found"))


@query(
    "priority_queue",
    f"WITH {PREDS_SQL} SELECT doc_id, round(score / (SELECT max(score) FROM preds), 9) AS score, row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM preds), 9) DESC, doc_id) AS rank FROM preds",
)
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to look at, by score; labels are not part of it."""
    preds = predictions(spark, sf_dir).select("doc_id", "score")
    most = preds.agg(F.max("score").alias("most"))
    scaled = preds.crossJoin(F.broadcast(most)).select("doc_id", F.round(F.col("score") / F.col("most"), 9).alias("score"))
    return in_order(scaled, [F.desc("score"), "doc_id"], rank="rank")


@query(
    "paired_wins_losses",
    f"""WITH {PREDS_SQL}, m AS (SELECT source, (avg(CASE WHEN (score >= 1500)::INT = target THEN 1.0 ELSE 0 END) >= 0.5) AS a,
        (avg(CASE WHEN (score_b >= 500)::INT = target THEN 1.0 ELSE 0 END) >= 0.5) AS b FROM preds GROUP BY source)
    SELECT count(*) FILTER (WHERE a AND NOT b) AS wins, count(*) FILTER (WHERE b AND NOT a) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM m""",
)
def paired_wins_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many sources one model is right more often than not, and the other isn't."""
    right = lambda s, t: F.avg(((F.col(s) >= t).cast("int") == F.col("target")).cast("double")) >= 0.5
    m = predictions(spark, sf_dir).groupBy("source").agg(right("score", 1500).alias("a"), right("score_b", 500).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.agg(F.count_if(a & ~b).alias("wins"), F.count_if(b & ~a).alias("losses"), F.count_if(a == b).alias("ties"))


@query(
    "label_conflicts",
    "SELECT source, count(DISTINCT quality) AS kinds, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(DISTINCT quality) > 1",
)
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose labels disagree."""
    return predictions(spark, sf_dir).groupBy("source").agg(F.countDistinct("target").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


@query(
    "retrieval_metrics",
    """WITH i AS (SELECT vec_id AS id, vec_id % 50 AS parent, label::BIGINT AS family, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.id AS src, a.family AS own, b.family, max(round(list_dot_product(a.v, b.v), 9)) AS score FROM i a JOIN i b ON a.parent <> b.parent AND a.id % 20 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, family) AS rank FROM s), e AS (SELECT src, rank FROM r WHERE family = own)
    SELECT count(*) AS queries, count(*) FILTER (WHERE rank = 1) AS correct, round(avg((rank = 1)::INT), 9) AS recall_1, round(avg((rank <= 5)::INT), 9) AS recall_5, median(rank) AS median_rank FROM e""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well queries find their own family: recall at one and five, median rank."""
    from collatrix.plans.vectors import family_maxsim_rank

    e = family_maxsim_rank(spark, sf_dir).where("expected")
    at = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 9)
    return e.agg(F.count("*").alias("queries"), F.count_if(F.col("rank") == 1).alias("correct"), at(1).alias("recall_1"), at(5).alias("recall_5"), F.median("rank").alias("median_rank"))


@query("bootstrap_auc")
def bootstrap_auc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of two scores' areas under the curve, from the same resamples."""
    return interval(bootstrap_auc(predictions(spark, sf_dir), ["score", "score_b"], "target", "doc_id", draws=500), "auc", ["model"])


@query("paired_bootstrap_delta")
def paired_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference between two scores' areas under the curve over the same resamples, with its interval and the share above 0."""
    return paired_delta(bootstrap_auc(predictions(spark, sf_dir), ["score", "score_b"], "target", "doc_id", draws=500, seed=7), "score_b", "score")


@query("view_mapping")
def view_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression from one half of the vectors to the other: cosine on held-out items per strength."""
    from collatrix.functions.scalar import dot, unit

    bank = items(spark, sf_dir).select("id", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))
    parts = normal_equations(bank.where("id % 5 <> 0"), "x", "y")
    rows = []
    for alpha in (0.01, 1.0, 100.0):
        w = ridge_from(parts, alpha)
        columns = [F.array(*[F.lit(float(v)) for v in w[:-1, j]]) for j in range(w.shape[1])]
        guess = F.array(*[dot(F.col("x"), c) + F.lit(float(b)) for c, b in zip(columns, w[-1], strict=True)])
        held = bank.where("id % 5 = 0").select("y", guess.alias("g"))
        rows.append(held.agg(F.lit(alpha).alias("alpha"), F.avg(dot(unit(F.col("g")), unit(F.col("y")))).alias("cosine"), F.count("*").alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
