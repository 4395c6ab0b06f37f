"""Contracts as queries: joins that must match, values that must be known, records that must be confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.operators import contracts as C
from collatrix.operators.dossier import correct
from collatrix.operators.review import ReviewSessions, policy_weight
from collatrix.operators.sessions import RevisionStore
from collatrix.plans.coverage import order_incidence
from collatrix.plans.registry import query
from collatrix.plans.sessions import REVIEWS_SQL, reviews
from collatrix.session import fresh_path
from collatrix.sources.tables import table


@query("join_asserted_one_to_one", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_asserted_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels, where no id may repeat on either side."""
    return C.join_one_to_one(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("join_asserted_many_to_one", "SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_asserted_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers, of whom none may repeat."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return C.join_many_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customer, ["o_custkey"])


@query("join_all_matched", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_all_matched_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's name, each of which must be there."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return C.join_all_matched(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"]).select("c_custkey", "n_name")


@query("drop_and_replace", "SELECT documents.* EXCLUDE (text, n_chars), length(text)::BIGINT AS n_chars FROM documents")
def drop_and_replace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose counts are dropped and taken from a table that was adjudicated."""
    docs = table(spark, sf_dir, "documents")
    fresh = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return C.drop_and_replace(docs, ["text", "n_chars"], fresh, ["doc_id"])


@query("prefixed_columns", "SELECT doc_id, name, value FROM (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels) UNPIVOT INCLUDE NULLS (value FOR name IN (quality, toxic))")
def prefixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of scores by their prefix, one row each."""
    scored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score_quality"), F.col("toxic").alias("score_toxic"))
    return C.prefixed(scored, ["doc_id"], "score_")


@query("enum_validation", f"WITH {REVIEWS_SQL} SELECT outcome, count(*) AS n FROM reviews GROUP BY outcome")
def enum_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes counted, after each was found to be a known one."""
    return C.expect_one_of(reviews(spark, sf_dir), "outcome", ["recorded", "uncertain", "excluded"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("policy_ratings", "SELECT p_partkey, (p_size % 5) / 4.0::DOUBLE * (1 - (p_partkey % 5) / 4.0::DOUBLE) AS weight FROM part")
def policy_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from two ratings of 0 to 4."""
    return table(spark, sf_dir, "part").select("p_partkey", policy_weight(F.col("p_size") % 5, F.col("p_partkey") % 5).alias("weight"))


@query(
    "golden_check",
    """SELECT c_nationkey AS key, sum(c_acctbal) AS golden, CASE WHEN c_nationkey % 5 = 1 THEN sum(c_acctbal) + 1 ELSE sum(c_acctbal) END AS found,
    CASE WHEN c_nationkey % 5 = 1 THEN 'differs' ELSE 'same' END AS verdict FROM customer GROUP BY c_nationkey""".replace("sum(c_acctbal)", "round(sum(c_acctbal), 2)"),
)
def golden_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded sums against recomputed ones, some of which were changed on purpose."""
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    found = sums.select("key", F.when(F.col("key") % 5 == 1, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return C.reverify(sums, found, ["key"], "v", 1e-7)


@query(
    "corrections_with_audit",
    f"""WITH {REVIEWS_SQL}, e AS (SELECT s_suppkey AS entry_id, 'status' AS field, 'unresolved' AS value FROM supplier),
    c AS (SELECT event_id AS pos, item AS entry_id, 'status' AS field, outcome AS value FROM reviews WHERE item BETWEEN 1 AND 10),
    l AS (SELECT entry_id, arg_max(value, pos) AS value, count(*) AS n FROM c GROUP BY entry_id)
    SELECT e.entry_id, coalesce(l.value, e.value) AS value, coalesce(n, 0) AS corrections FROM e LEFT JOIN l USING (entry_id)""",
)
def corrections_with_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after corrections, and how many corrections the audit has of each."""
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("entry_id"), F.lit("status").alias("field"), F.lit("unresolved").alias("value"))
    made = reviews(spark, sf_dir).where("item BETWEEN 1 AND 10").select(F.col("event_id").alias("pos"), F.col("item").alias("entry_id"), F.lit("status").alias("field"), F.col("outcome").alias("value"))
    revised, audit = correct(entries, made)
    n = audit.groupBy("entry_id").agg(F.count("*").alias("corrections"))
    return revised.join(n, "entry_id", "left").select("entry_id", "value", F.coalesce("corrections", F.lit(0)).alias("corrections"))


@query("dossier_list", "SELECT 'dossier ' || r_regionkey AS key, CASE WHEN r_regionkey < 2 THEN 2 ELSE 1 END AS revision, CASE WHEN r_regionkey < 2 THEN 2 ELSE 1 END::BIGINT AS revisions, CASE WHEN r_regionkey < 2 THEN 'changed' ELSE r_name END AS state FROM region")
def dossier_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dossiers of a store by key, with their last revision; two were revised."""
    store = RevisionStore(spark, fresh_path(spark, "dossiers"))
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        key = f"dossier {r['r_regionkey']}"
        store.create(key, r["r_name"])
        if r["r_regionkey"] < 2:
            store.revise(key, "changed", 1)
    return store.listing()


@query("create_session")
def create_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new session's first batch, after one review of it: position, item and whether it is pending."""
    incidence = order_incidence(spark, sf_dir).withColumn("item", F.col("item").cast("string"))
    sessions = ReviewSessions(spark, fresh_path(spark, "sessions"), incidence)
    state = sessions.create(5)
    state = sessions.review(state.session, state.version, state.plan[0], "recorded", "seen")
    rows = [(n, item, item in state.pending()) for n, item in enumerate(state.plan, 1)]
    return spark.createDataFrame(rows, "position int, item string, is_pending boolean")
