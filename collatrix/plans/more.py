"""Set operations, features, comparisons between plans, and checks, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.contracts import missing_keys
from collatrix.operators.coverage import greedy_plan
from collatrix.operators.graph import sensitivity
from collatrix.operators.groupstats import adjusted_rand, core_and_edge
from collatrix.operators.models import group_features
from collatrix.operators.ranking import competition_rank
from collatrix.plans.coverage import INCIDENCE_SQL, order_incidence
from collatrix.plans.graph import near_edges
from collatrix.plans.groupstats import medoid_percentiles
from collatrix.plans.registry import query
from collatrix.sources.tables import table


@query(
    "set_operations",
    """WITH a AS (SELECT user_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id FROM events WHERE event_type = 'view')
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'except all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of unions, intersections and differences of two sets of users."""
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'view'").select("user_id")
    sets = {"union": a.union(b).distinct(), "union all": a.unionAll(b), "intersect": a.intersect(b), "except": a.subtract(b), "except all": a.exceptAll(b)}
    counted = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, x in sets.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionAll(c)
    return out


@query(
    "missing_keys",
    "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def missing_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return missing_keys(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query(
    "group_features",
    """WITH n AS (SELECT user_id AS item, event_type AS grp, ln(1 + count(*)) AS w, greatest(max(value), 0) AS strength FROM events GROUP BY ALL)
    SELECT item, grp, 1 AS presence, round(w / greatest(sum(w) OVER (PARTITION BY item), 1), 9) AS share, round(strength, 9) AS strength FROM n""",
)
def group_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, relative count and strength of event types per user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("grp"), F.col("value").alias("strength"))
    return group_features(e).select("item", "grp", "presence", F.round("share", 9).alias("share"), F.round("strength", 9).alias("strength"))


@query(
    "change_detection",
    """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events WHERE event_id < (SELECT count(*) // 2 FROM events) GROUP BY user_id),
    b AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)
    SELECT user_id, a.kind AS kind_previous, b.kind AS kind_current FROM a JOIN b USING (user_id) WHERE a.kind <> b.kind""",
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event type is another than at half time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    half = e.agg(F.floor(F.count("*") / 2).alias("half"))
    last = lambda df, name: df.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias(name))
    before = e.crossJoin(F.broadcast(half)).where("event_id < half")
    return last(before, "kind_previous").join(last(e, "kind_current"), "user_id").where("kind_previous <> kind_current")


@query(
    "feedback_counterfactual",
    f"""WITH inc AS ({INCIDENCE_SQL}), seen AS (SELECT grp, count(*) AS n FROM inc WHERE item IN (1, 2, 3) GROUP BY grp),
    alt AS (SELECT grp, count(*) AS n FROM inc WHERE item IN (1, 2) GROUP BY grp),
    a AS (SELECT item, count(*) AS n FROM inc WHERE item NOT IN (1, 2, 3) AND grp NOT IN (SELECT grp FROM seen WHERE n >= 2) GROUP BY item ORDER BY n DESC, item LIMIT 1),
    b AS (SELECT item, count(*) AS n FROM inc WHERE item NOT IN (1, 2, 3) AND grp NOT IN (SELECT grp FROM alt WHERE n >= 2) GROUP BY item ORDER BY n DESC, item LIMIT 1)
    SELECT 'recorded' AS feedback, item, n * 0.5::DOUBLE AS gain, (SELECT count(*) FROM seen) AS groups_before FROM a
    UNION ALL SELECT 'excluded', item, n * 0.5::DOUBLE, (SELECT count(*) FROM alt) FROM b""",
)
def feedback_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next item if item 3 was recorded, and if it was excluded instead; and the groups seen before it."""
    inc = order_incidence(spark, sf_dir)
    out = []
    for name, done, pool in (("recorded", (1, 2, 3), inc), ("excluded", (1, 2), inc.where("item <> 3"))):
        reviewed = spark.createDataFrame([(i,) for i in done], "item long")
        seen = inc.join(F.broadcast(reviewed), "item", "left_semi").select("grp").distinct().count()
        _, item, gain = greedy_plan(pool, 1, reviewed=reviewed)[0]
        out.append((name, item, gain, seen))
    return spark.createDataFrame(out, "feedback string, item long, gain double, groups_before long")


@query("review_sample")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to look at in each family: near the medoid, far from it, and some by a hash."""
    return core_and_edge(medoid_percentiles(spark, sf_dir), "family", "percentile", "id")


@query("partition_stability")
def partition_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of communities between seeds, per resolution."""
    grid = sensitivity(near_edges(spark, sf_dir), (0.5, 1.0, 2.0), (7, 11))
    out = []
    for r in (0.5, 1.0, 2.0):
        own = grid.where(F.col("resolution") == r)
        pairs = own.where("seed = 7").select("node", F.col("label").alias("x")).join(own.where("seed = 11").select("node", F.col("label").alias("y")), "node")
        out.append(adjusted_rand(pairs, "x", "y").select(F.lit(r).alias("resolution"), "ari"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "community_pairs",
    """SELECT a.c_mktsegment AS low, b.c_mktsegment AS high, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) a
    JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment <= b.c_mktsegment GROUP BY ALL""",
)
def community_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many nations two segments have customers; a segment with itself counts too."""
    held = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    a, b = held.withColumnRenamed("c_mktsegment", "low"), held.withColumnRenamed("c_mktsegment", "high")
    return a.join(b, "c_nationkey").where("low <= high").groupBy("low", "high").agg(F.count("*").alias("n"))


@query(
    "event_props_stats",
    """SELECT event_type, count(*) AS n, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most,
    date_trunc('hour', min(ts)) AS first_hour FROM events GROUP BY event_type""",
)
def event_props_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested properties aggregated per event type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    first = F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("first_hour")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds"), F.max("k").alias("most"), first)


@query(
    "supplier_priority_interleave",
    """WITH r AS (SELECT s_suppkey, s_nationkey, rank() OVER (ORDER BY s_acctbal DESC) AS place, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS in_nation FROM supplier)
    SELECT s_suppkey, place, in_nation FROM r WHERE in_nation <= 2""",
)
def supplier_priority_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition ranks over all, and places in each nation, of its two best suppliers."""
    s = table(spark, sf_dir, "supplier")
    own = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    best = s.select("s_suppkey", "s_acctbal", own.alias("in_nation")).where("in_nation <= 2")
    return best.join(competition_rank(s, "s_acctbal"), "s_acctbal").select("s_suppkey", "place", "in_nation")
