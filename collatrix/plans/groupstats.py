"""Group statistics as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.functions.scalar import count_map, dot, steps
from collatrix.operators.ranking import competition_rank
from collatrix.operators import groupstats as G
from collatrix.operators.graph import endpoints
from collatrix.operators.ingest import best_per_group
from collatrix.plans.coverage import order_incidence
from collatrix.plans.registry import query
from collatrix.plans.vectors import ITEMS_SQL, items
from collatrix.sources.tables import table


def brand_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (item, grp): an order is an item, the brands of its parts are groups."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("p_partkey"))
    return line.join(part, "p_partkey").select("item", "grp").distinct()


BRANDS_SQL = "inc AS (SELECT DISTINCT l_orderkey AS item, p_brand AS grp FROM lineitem JOIN part ON l_partkey = p_partkey)"
IDF_SQL = """idf AS (SELECT grp, count(*) AS df, least(3.0::DOUBLE, ln(((SELECT count(*) FROM orders) + 1.0::DOUBLE) / (count(*) + 1)) + 1) AS weight FROM inc GROUP BY grp)"""


@query("idf_weights", f"WITH {BRANDS_SQL}, {IDF_SQL} SELECT grp, df, round(weight, 9) AS weight FROM idf")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of groups that fall with how many items have them; items without groups count too."""
    n = table(spark, sf_dir, "orders").count()
    return G.idf_weights(brand_incidence(spark, sf_dir), n).withColumn("weight", F.round("weight", 9))


@query("cooccurrence", f"WITH {BRANDS_SQL} SELECT x.grp AS a, y.grp AS b, count(*) AS n FROM inc x JOIN inc y USING (item) WHERE x.grp < y.grp GROUP BY 1, 2")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items have both groups of a pair."""
    return G.cooccurrence(brand_incidence(spark, sf_dir))


@query(
    "weighted_jaccard_links",
    """WITH inc AS (SELECT DISTINCT l_orderkey AS item, p_brand || '|' || p_type AS grp FROM lineitem JOIN part ON l_partkey = p_partkey),
    idf AS (SELECT grp, least(6.0::DOUBLE, ln(((SELECT count(*) FROM orders) + 1.0::DOUBLE) / (count(*) + 1)) + 1) AS weight FROM inc GROUP BY grp),
    sets AS (SELECT item, string_agg(grp, ';' ORDER BY grp) AS s FROM inc GROUP BY item), cls AS (SELECT item, min(item) OVER (PARTITION BY s) AS class_id FROM sets),
    w AS (SELECT item, grp, weight FROM inc JOIN idf USING (grp) WHERE item IN (SELECT class_id FROM cls)), t AS (SELECT item, sum(weight) AS total FROM w GROUP BY item),
    p AS (SELECT x.item AS a, y.item AS b, sum(x.weight) AS common FROM w x JOIN w y USING (grp) WHERE x.item < y.item GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN t ta ON ta.item = a JOIN t tb ON tb.item = b WHERE common / (ta.total + tb.total - common) >= 0.8::DOUBLE - 1e-9),
    n AS (SELECT c, count(*) AS links FROM (SELECT a AS c FROM l UNION ALL SELECT b FROM l) GROUP BY c)
    SELECT item, class_id, coalesce(links, 0) AS links FROM cls LEFT JOIN n ON c = class_id""",
)
def weighted_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's class of equal group sets, and how many other classes are similar to it by 0.8 or more."""
    inc = order_incidence(spark, sf_dir)
    weights = G.idf_weights(inc, table(spark, sf_dir, "orders").count(), 6.0)
    classes, links = G.weighted_jaccard(inc, weights, 0.8)
    n = endpoints(links).groupBy(F.col("node").alias("class_id")).agg(F.count("*").alias("links"))
    return classes.join(n, "class_id", "left").select("item", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


ORDER_NATION_SQL = "o AS (SELECT o_orderkey, o_orderpriority, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"


def order_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("c_custkey"))
    return orders.join(customer, "c_custkey")


@query(
    "entropy_by_group",
    f"""WITH {ORDER_NATION_SQL}, n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM o GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY c_mktsegment) AS share FROM n)
    SELECT c_mktsegment, count(*) AS kinds, round(max(share), 9) AS largest_share, round(-sum(share * ln(share)) / ln(count(*)), 9) AS entropy FROM s GROUP BY c_mktsegment""",
)
def entropy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly each segment's orders spread over nations."""
    out = G.entropy(order_nations(spark, sf_dir), "c_mktsegment", "c_nationkey")
    return out.select("c_mktsegment", "kinds", F.round("largest_share", 9).alias("largest_share"), F.round("entropy", 9).alias("entropy"))


@query(
    "largest_share",
    f"""WITH {ORDER_NATION_SQL}, n AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM o GROUP BY ALL)
    SELECT c_nationkey, max(n) AS most, sum(n)::BIGINT AS total, round(max(n) / sum(n), 9) AS share, arg_max(o_orderpriority, n * 100 - ascii(o_orderpriority)) AS kind FROM n GROUP BY c_nationkey""",
)
def largest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common priority of each nation and its share."""
    n = order_nations(spark, sf_dir).groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = F.max_by("o_orderpriority", F.col("n") * 100 - F.ascii("o_orderpriority"))
    return n.groupBy("c_nationkey").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.round(F.max("n") / F.sum("n"), 9).alias("share"), best.alias("kind"))


@query(
    "count_map_json",
    f"""WITH {ORDER_NATION_SQL}, n AS (SELECT c_mktsegment, o_orderpriority AS k, count(*) AS n FROM o GROUP BY ALL)
    SELECT c_mktsegment, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS counts FROM n GROUP BY c_mktsegment""",
)
def count_map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of priorities per segment, as JSON sorted by key."""
    n = order_nations(spark, sf_dir).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.groupBy("c_mktsegment").agg(count_map(F.col("o_orderpriority"), F.col("n")).alias("counts"))


@query(
    "crosstab_pivot",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) AS total FROM events GROUP BY user_id""",
)
def crosstab_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as columns, 0 where there are none, and all events as denominator."""
    kinds = ["click", "view", "purchase"]
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    wide = events.groupBy("user_id").pivot("event_type", kinds).count().na.fill(0, kinds)
    return wide.join(events.groupBy("user_id").agg(F.count("*").alias("total")), "user_id")


@query(
    "count_histogram",
    "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size",
)
def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have how many lines."""
    return G.count_histogram(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query(
    "quantile_summary",
    """SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, median(n_chars) AS middle, quantile_cont(n_chars, 0.25) AS low, quantile_cont(n_chars, 0.9) AS high,
    round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS spread FROM documents GROUP BY lang""",
)
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles with linear interpolation, and moments."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n"),
            F.min("n_chars").alias("least"),
            F.max("n_chars").alias("most"),
            F.median("n_chars").alias("middle"),
            F.percentile("n_chars", F.lit(0.25)).alias("low"),
            F.percentile("n_chars", F.lit(0.9)).alias("high"),
            F.round(F.avg("n_chars"), 6).alias("mean"),
            F.round(F.stddev_pop("n_chars"), 6).alias("spread"),
        )
    )


MEDOID_SQL = f"""{ITEMS_SQL}, pairs AS (SELECT a.family, a.id, sum(round(list_dot_product(a.v, b.v), 9)) AS s FROM items a JOIN items b ON a.family = b.family AND a.id <> b.id GROUP BY ALL),
    medoid AS (SELECT family, id AS medoid FROM pairs QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(s, 6) DESC, id) = 1)"""


def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, medoid): the item nearest to all of its family; a sum of vectors stands for the pairs."""
    bank = items(spark, sf_dir)
    total = bank.select("family", F.posexplode("v").alias("i", "x")).groupBy("family", "i").agg(F.sum("x").alias("x"))
    total = total.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t")).select("family", F.transform("t", lambda s: s["x"]).alias("t"))
    scored = bank.join(F.broadcast(total), "family").withColumn("s", F.round(dot(F.col("v"), F.col("t")) - dot(F.col("v"), F.col("v")), 6))
    return best_per_group(scored, ["family"], [F.desc("s"), "id"]).select("family", F.col("id").alias("medoid"))


@query("medoid_per_label", f"WITH {MEDOID_SQL} SELECT family, medoid FROM medoid")
def medoid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most central item of each family."""
    return medoids(spark, sf_dir)


PERCENTILE_SQL = f"""{MEDOID_SQL}, near AS (SELECT i.id, i.family, round(list_dot_product(i.v, m.v), 9) AS sim FROM items i JOIN medoid USING (family) JOIN items m ON m.id = medoid),
    placed AS (SELECT *, round(cume_dist() OVER (PARTITION BY family ORDER BY sim), 9) AS percentile FROM near)"""


def medoid_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, family, sim, percentile) of items by similarity to their family's medoid."""
    bank = items(spark, sf_dir)
    centre = medoids(spark, sf_dir).join(bank.select(F.col("id").alias("medoid"), F.col("v").alias("mv")), "medoid")
    near = bank.join(F.broadcast(centre), "family").select("id", "family", F.round(dot(F.col("v"), F.col("mv")), 9).alias("sim"))
    return near.withColumn("percentile", F.round(G.cume_percentile("sim", "family"), 9))


@query("percentile_in_group", f"WITH {PERCENTILE_SQL} SELECT id, family, percentile FROM placed")
def percentile_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's percentile of similarity to the medoid of its family."""
    return medoid_percentiles(spark, sf_dir).select("id", "family", "percentile")


@query(
    "support_consensus",
    f"""WITH {PERCENTILE_SQL}, marked AS (SELECT id, id % 50 AS parent, family, percentile, percentile >= 0.5 AS core,
        CASE WHEN percentile >= 0.75 THEN 4 WHEN percentile >= 0.6 THEN 3 WHEN percentile >= 0.45 THEN 2 WHEN percentile >= 0.3 THEN 1 ELSE 0 END AS mark FROM placed)
    SELECT parent, family, id, core, mark FROM marked QUALIFY row_number() OVER (PARTITION BY parent, family ORDER BY core DESC, percentile DESC, id) = 1""",
)
def support_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each parent for each family."""
    p = medoid_percentiles(spark, sf_dir)
    cuts = [(0.75, 4), (0.6, 3), (0.45, 2), (0.3, 1)]
    marked = p.select("id", (F.col("id") % 50).alias("parent"), "family", "percentile", (F.col("percentile") >= 0.5).alias("core"), steps(F.col("percentile"), cuts).alias("mark"))
    return best_per_group(marked, ["parent", "family"], [F.desc("core"), F.desc("percentile"), "id"]).drop("percentile")


@query(
    "max_jaccard_partitions",
    f"""WITH {ITEMS_SQL}, x AS (SELECT id, family AS label FROM items), y AS (SELECT id, CASE WHEN id % 11 = 0 THEN -1 ELSE parent % 7 END AS other FROM items),
    n AS (SELECT label, count(*) AS n FROM x GROUP BY label), m AS (SELECT other, count(*) AS m FROM y WHERE other >= 0 GROUP BY other),
    k AS (SELECT label, other, count(*) AS k FROM x JOIN y USING (id) WHERE other >= 0 GROUP BY ALL)
    SELECT label, n, round(max(k / (n + m - k)), 9) AS best FROM n JOIN k USING (label) JOIN m USING (other) GROUP BY label, n""",
)
def max_jaccard_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family against its most similar group of another partition."""
    bank = items(spark, sf_dir)
    main = bank.select(F.col("id").alias("node"), F.col("family").alias("label"))
    other = bank.select(F.col("id").alias("node"), F.when(F.col("id") % 11 == 0, F.lit(-1)).otherwise(F.col("parent") % 7).alias("label"))
    return G.max_jaccard(main, other).withColumn("best", F.round("best", 9))


@query(
    "ari_partitions",
    """WITH p AS (SELECT event_type AS x, user_id % 4 AS y FROM events), c AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL),
    b AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS same, sum(n)::DOUBLE AS total FROM c),
    rx AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ry AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY y))
    SELECT round((same - rx.s * ry.s / (total * (total - 1) / 2)) / ((rx.s + ry.s) / 2 - rx.s * ry.s / (total * (total - 1) / 2)), 9) AS ari FROM b, rx, ry""",
)
def ari_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labellings of the events, corrected for chance."""
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("x"), (F.col("user_id") % 4).alias("y"))
    return G.adjusted_rand(pairs, "x", "y").withColumn("ari", F.round("ari", 9))


@query(
    "group_correlation",
    "SELECT l_returnflag, CASE WHEN count(*) > 1 THEN round(corr(l_quantity, l_extendedprice), 9) END AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
def group_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation per group; null for a single row."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return line.agg(F.when(F.count("*") > 1, F.round(F.corr("l_quantity", "l_extendedprice"), 9)).alias("r"), F.count("*").alias("n"))


@query(
    "interest_score",
    f"""WITH {ITEMS_SQL}, s AS (SELECT family, count(*) AS members, count(DISTINCT parent) AS parents, count(DISTINCT parent % 5) AS contexts FROM items GROUP BY family),
    t AS (SELECT *, greatest(0::DOUBLE, 100 * (0.5::DOUBLE * least(4, members / 15.0::DOUBLE) / 4 + 0.5::DOUBLE * least(4, parents / 10.0::DOUBLE) / 4) - 15 * (5 - contexts) / 4.0::DOUBLE) AS score FROM s)
    SELECT family, round(score, 6) AS score, rank() OVER (ORDER BY round(score, 6) DESC) AS place,
    CASE WHEN members >= 50 THEN 'broad' WHEN members >= 20 THEN 'common' WHEN members >= 5 THEN 'some' ELSE 'rare' END AS tier FROM t""",
)
def interest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score of families with a penalty, its competition rank, and a tier."""
    s = items(spark, sf_dir).groupBy("family").agg(F.count("*").alias("members"), F.countDistinct("parent").alias("parents"), F.countDistinct(F.col("parent") % 5).alias("contexts"))
    part = lambda c, per: F.lit(0.5) * F.least(F.lit(4.0), F.col(c) / F.lit(per)) / 4
    score = F.greatest(F.lit(0.0), 100 * (part("members", 15.0) + part("parents", 10.0)) - 15 * (5 - F.col("contexts")) / F.lit(4.0))
    tier = F.when(F.col("members") >= 50, "broad").when(F.col("members") >= 20, "common").when(F.col("members") >= 5, "some").otherwise("rare")
    scored = s.select("family", F.round(score, 6).alias("score"), tier.alias("tier"))
    return scored.join(competition_rank(scored, "score"), "score").select("family", "score", "place", "tier")
