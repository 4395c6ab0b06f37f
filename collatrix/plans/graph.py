"""Graph queries over the 15 nearest neighbours of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.graph import capped_extra_edges, communities, connected_components, endpoints, fuse, modularity, mutual_edges, parent_normalized, rank_affinity, spanning_forest
from collatrix.operators.vectors import search
from collatrix.plans.registry import query
from collatrix.plans.vectors import ITEMS_SQL, items, ranked_sql, sims_sql

K = 15


def neighbours(spark: SparkSession, sf_dir: str, half: bool = False, k: int = K) -> DataFrame:
    bank = items(spark, sf_dir, half)
    return search(bank, bank, k, "parent").select("src", "dst", "rank")


AFFINITY_SQL = """SELECT least(src, dst) AS a, greatest(src, dst) AS b, max((16 - rank) / 15::DOUBLE)
    * (0.35::DOUBLE + 0.65::DOUBLE * CASE WHEN count(*) = 1 THEN 0 ELSE min((16 - rank) / 15::DOUBLE) END) AS weight, count(*) > 1 AS mutual FROM {ranked} GROUP BY 1, 2"""


@query("rank_affinity_edges", ranked_sql(K) + f" SELECT a, b, round(weight, 9) AS weight, mutual FROM ({AFFINITY_SQL.format(ranked='ranked')})")
def rank_affinity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges weighed by the ranks of both directions."""
    return rank_affinity(neighbours(spark, sf_dir), K).withColumn("weight", F.round("weight", 9))


TWO_VIEWS_SQL = f"""WITH {ITEMS_SQL}, {sims_sql("a.parent <> b.parent", False)}, {sims_sql("a.parent <> b.parent", False, "half").replace("sims AS", "sims2 AS", 1)},
    ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= {K}),
    ranked2 AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims2 QUALIFY rank <= {K}),
    e1 AS ({AFFINITY_SQL.format(ranked="ranked")}), e2 AS ({AFFINITY_SQL.format(ranked="ranked2")}),
    fused AS (SELECT a, b, 0.5::DOUBLE * (coalesce(e1.weight, 0) + coalesce(e2.weight, 0)) + 0.5::DOUBLE * least(coalesce(e1.weight, 0), coalesce(e2.weight, 0)) AS weight,
        (e1.weight IS NOT NULL)::INT + (e2.weight IS NOT NULL)::INT AS n_views FROM e1 FULL JOIN e2 USING (a, b))"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(rank_affinity(neighbours(spark, sf_dir), K), rank_affinity(neighbours(spark, sf_dir, half=True), K))


@query("fused_edges", TWO_VIEWS_SQL + " SELECT a, b, round(weight, 9) AS weight, n_views FROM fused")
def fused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two views' edges."""
    return fused(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(
    "community_edge_rollup",
    TWO_VIEWS_SQL
    + """ SELECT least(x.family, y.family) AS low, greatest(x.family, y.family) AS high, count(*) AS edges, round(sum(weight), 6) AS weight, round(ln(1 + sum(weight)), 6) AS quotient
    FROM fused JOIN items x ON x.id = a JOIN items y ON y.id = b GROUP BY 1, 2""",
)
def community_edge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges summed per pair of families."""
    family = items(spark, sf_dir).select("id", "family")
    named = fused(spark, sf_dir).join(family.select(F.col("id").alias("a"), F.col("family").alias("fa")), "a").join(family.select(F.col("id").alias("b"), F.col("family").alias("fb")), "b")
    grouped = named.groupBy(F.least("fa", "fb").alias("low"), F.greatest("fa", "fb").alias("high")).agg(F.count("*").alias("edges"), F.sum("weight").alias("w"))
    return grouped.select("low", "high", "edges", F.round("w", 6).alias("weight"), F.round(F.log(1 + F.col("w")), 6).alias("quotient"))


MUTUAL_SQL = ranked_sql(K).replace(" ranked AS (", " ranked AS MATERIALIZED (") + ", mutual AS (SELECT x.src AS a, x.dst AS b, x.rank AS rank_a, y.rank AS rank_b FROM ranked x JOIN ranked y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst)"


@query("mutual_edges", MUTUAL_SQL + " SELECT a, b, rank_a, rank_b, round(sqrt(rank_a * rank_b), 9) AS effective_rank FROM mutual")
def mutual_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that name each other, with both ranks."""
    return mutual_edges(neighbours(spark, sf_dir)).withColumn("effective_rank", F.round(F.sqrt(F.col("rank_a") * F.col("rank_b")), 9))


@query(
    "parent_normalized_weights",
    MUTUAL_SQL
    + """, ends AS (SELECT a, b, a AS node, 1.0::DOUBLE / rank_a AS w FROM mutual UNION ALL SELECT a, b, b, 1.0::DOUBLE / rank_b FROM mutual),
    shares AS (SELECT a, b, w / sum(w) OVER (PARTITION BY node % 50) AS share FROM ends)
    SELECT a, b, round(sum(share) / 2, 9) AS weight FROM shares GROUP BY a, b""",
)
def parent_normalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights such that every parent counts alike."""
    parents = items(spark, sf_dir).select(F.col("id").alias("node"), "parent")
    return parent_normalized(mutual_edges(neighbours(spark, sf_dir)), parents).withColumn("weight", F.round("weight", 9))


@query(
    "degrees_and_isolates",
    ranked_sql(2).replace("ranked AS", "top AS", 1)
    + """, mutual AS (SELECT x.src AS a, x.dst AS b FROM top x JOIN top y ON x.src = y.dst AND x.dst = y.src),
    deg AS (SELECT a AS id, count(*) AS n FROM mutual GROUP BY a)
    SELECT coalesce(n, 0) AS degree, count(*) AS items FROM items LEFT JOIN deg USING (id) GROUP BY 1""",
)
def degrees_and_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items have how many mutual neighbours among the nearest two."""
    degree = endpoints(mutual_edges(neighbours(spark, sf_dir, k=2))).groupBy("node").agg(F.count("*").alias("n"))
    all_items = items(spark, sf_dir).select(F.col("id").alias("node"))
    return all_items.join(degree, "node", "left").groupBy(F.coalesce("n", F.lit(0)).alias("degree")).agg(F.count("*").alias("items"))


def near_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual edges among the nearest two: sparse enough for several components."""
    found = mutual_edges(neighbours(spark, sf_dir, k=2))
    return found.select("a", "b", (F.lit(1.0) / (F.col("rank_a") + F.col("rank_b"))).alias("weight"))


@query(
    "connected_components",
    ranked_sql(2).replace("WITH", "WITH RECURSIVE", 1)
    + """, both_ways AS (SELECT x.src AS a, x.dst AS b FROM ranked x JOIN ranked y ON x.src = y.dst AND x.dst = y.src),
    reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node)
    SELECT node, min(root) AS root FROM reach GROUP BY node""",
)
def connected_components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each item that has a mutual near neighbour."""
    return connected_components(near_edges(spark, sf_dir))


@query("spanning_forest")
def spanning_forest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum spanning forest of the near edges."""
    return spanning_forest(near_edges(spark, sf_dir))


@query("community_detection")
def community_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the mutual graph, numbered by size."""
    edges = mutual_edges(neighbours(spark, sf_dir)).select("a", "b", (F.lit(1.0) / (F.col("rank_a") + F.col("rank_b"))).alias("weight"))
    return communities(edges)


@query("capped_extra_edges")
def capped_extra_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges beside the forest, at most two per item."""
    edges = near_edges(spark, sf_dir)
    return capped_extra_edges(edges, spanning_forest(edges))


@query(
    "partition_quality",
    MUTUAL_SQL
    + """, e AS (SELECT a, b, x.family AS fa, y.family AS fb FROM mutual JOIN items x ON x.id = a JOIN items y ON y.id = b),
    d AS (SELECT f, count(*)::DOUBLE AS d FROM (SELECT fa AS f FROM e UNION ALL SELECT fb FROM e) GROUP BY f),
    i AS (SELECT fa AS f, count(*)::DOUBLE AS w FROM e WHERE fa = fb GROUP BY fa), m AS (SELECT count(*)::DOUBLE AS m FROM e)
    SELECT round(sum(coalesce(w, 0) / m - (d / (2 * m)) ** 2), 9) AS quality, count(*) AS communities FROM d LEFT JOIN i USING (f), m""",
)
def partition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the families on the mutual graph."""
    edges = mutual_edges(neighbours(spark, sf_dir)).select("a", "b", F.lit(1.0).alias("weight"))
    labels = items(spark, sf_dir).select(F.col("id").alias("node"), F.col("family").alias("label"))
    return modularity(edges, labels).withColumn("quality", F.round("quality", 9))


@query(
    "neighbour_overlap",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.parent <> b.parent", False)}, {sims_sql("a.parent <> b.parent", False, "half").replace("sims AS", "sims2 AS", 1)},
    r1 AS (SELECT src, dst FROM sims QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {K}),
    r2 AS (SELECT src, dst FROM sims2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {K})
    SELECT src, count(*) AS shared FROM r1 JOIN r2 USING (src, dst) GROUP BY src""",
)
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours two views share, for each item that shares any."""
    lists = [neighbours(spark, sf_dir, half).groupBy("src").agg(F.collect_list("dst").alias(f"n{int(half)}")) for half in (False, True)]
    both = lists[0].join(lists[1], "src").select("src", F.size(F.array_intersect("n0", "n1")).cast("long").alias("shared"))
    return both.where("shared > 0")


@query(
    "reciprocal_rank_order",
    MUTUAL_SQL + " SELECT a, b, row_number() OVER (ORDER BY rank_a + rank_b, a, b) AS position FROM mutual QUALIFY position <= 50",
)
def reciprocal_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 closest mutual edges."""
    best = mutual_edges(neighbours(spark, sf_dir)).select("a", "b", (F.col("rank_a") + F.col("rank_b")).alias("s")).orderBy("s", "a", "b").limit(50)
    return best.select("a", "b", F.row_number().over(W.orderBy("s", "a", "b")).alias("position"))
