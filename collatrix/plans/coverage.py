"""Coverage queries: which items add most to the groups seen so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.coverage import coverage_at, gains, plan_frame, static_order
from collatrix.operators.ingest import interleave, shuffled, top_per_group
from collatrix.plans.registry import query
from collatrix.sources.tables import table

REVIEWED = (1, 2, 3, 4, 5)


def order_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (item, grp): an order is an item, brand and type of its parts are groups."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("grp"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), "l_partkey")
    return line.join(part, line.l_partkey == part.p_partkey).select("item", "grp").distinct()


def order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, context): an order's context is its customer's nation."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("context"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey").join(customer, "o_custkey").select("item", "context")


INCIDENCE_SQL = "SELECT DISTINCT l_orderkey AS item, p_brand || '|' || p_type AS grp FROM lineitem JOIN part ON l_partkey = p_partkey"
CONTEXT_SQL = "ctx AS (SELECT o_orderkey AS item, c_nationkey AS context FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(
    "coverage_step_gain",
    f"""WITH inc AS ({INCIDENCE_SQL}),
    seen AS (SELECT grp, count(*) AS n FROM inc WHERE item IN {REVIEWED} GROUP BY grp)
    SELECT inc.item, sum(0.5::DOUBLE) AS gain, count(*) AS n_groups
    FROM inc LEFT JOIN seen ON inc.grp = seen.grp
    WHERE coalesce(seen.n, 0) < 2 AND inc.item NOT IN {REVIEWED}
    GROUP BY inc.item ORDER BY gain DESC, inc.item LIMIT 25""",
)
def coverage_step_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 items that add most after items 1 to 5 were reviewed, each group counting twice at most."""
    inc = order_incidence(spark, sf_dir)
    done = F.col("item").isin(*REVIEWED)
    seen = inc.where(done).groupBy("grp").agg(F.count("*").alias("n"))
    return (
        inc.where(~done)
        .join(seen, "grp", "left")
        .where(F.coalesce("n", F.lit(0)) < 2)
        .groupBy("item")
        .agg(F.sum(F.lit(0.5)).alias("gain"), F.count("*").alias("n_groups"))
        .orderBy(F.desc("gain"), "item")
        .limit(25)
    )


def greedy_sql(steps: int) -> str:
    """The greedy choice written out: every step's pick from the picks before it."""
    parts = [f"inc AS MATERIALIZED ({INCIDENCE_SQL})"]
    for s in range(1, steps + 1):
        before = " UNION ALL ".join(f"SELECT item FROM p{i}" for i in range(1, s)) or "SELECT -1 AS item"
        parts.append(
            f"""p{s} AS MATERIALIZED (SELECT {s}::INT AS rank, item, count(*) * 0.5::DOUBLE AS gain FROM inc
            WHERE item NOT IN ({before}) AND grp NOT IN (SELECT grp FROM inc WHERE item IN ({before}) GROUP BY grp HAVING count(*) >= 2)
            GROUP BY item ORDER BY gain DESC, item LIMIT 1)"""
        )
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM p{s}" for s in range(1, steps + 1))


@query("coverage_greedy5", greedy_sql(5))
def coverage_greedy5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five items of the greedy plan."""
    return plan_frame(order_incidence(spark, sf_dir), budget=5)


@query("coverage_greedy_plan")
def coverage_greedy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy plan after five reviewed items, as long as something is added."""
    reviewed = spark.createDataFrame([(i,) for i in REVIEWED], "item long")
    return plan_frame(order_incidence(spark, sf_dir), budget=100, reviewed=reviewed)


STATIC_SQL = f"""inc AS ({INCIDENCE_SQL}), ranked AS (SELECT item, count(*)::DOUBLE AS utility, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM inc GROUP BY item),
    budgets(budget) AS (VALUES (10), (25), (50), (100))"""


@query("coverage_static_order", f"WITH {STATIC_SQL} SELECT rank, item, utility FROM ranked WHERE rank <= 100")
def coverage_static_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred items by all that they have."""
    top = static_order(order_incidence(spark, sf_dir)).orderBy(F.desc("utility"), "item").limit(100)
    return top.select(F.row_number().over(W.orderBy(F.desc("utility"), "item")).alias("rank"), "item", "utility")


def budget_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in (10, 25, 50, 100)], "budget int")


@query(
    "coverage_metrics_by_budget",
    f"""WITH {STATIC_SQL}, n AS (SELECT budget, grp, count(*) AS n FROM budgets JOIN ranked ON rank <= budget JOIN inc USING (item) GROUP BY ALL)
    SELECT budget, least(budget, (SELECT count(*) FROM ranked)) AS items, count(*) AS groups_seen, count(*) FILTER (WHERE n >= 2) AS groups_repeated,
    round(sum(least(n, 2) / 2.0::DOUBLE), 9) AS weighted_coverage FROM n GROUP BY budget""",
)
def coverage_metrics_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the static order covers at four budgets."""
    order = coverage_static_order(spark, sf_dir).select("rank", "item")
    return coverage_at(order, order_incidence(spark, sf_dir), budget_frame(spark))


@query(
    "coverage_random_baseline",
    f"""WITH {STATIC_SQL}, seeds AS (SELECT unnest(range(1, 21))::INT AS seed),
    orders AS (SELECT seed, item, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '-' || item), item) AS place FROM ranked, seeds QUALIFY place <= 100),
    n AS (SELECT seed, budget, grp, count(*) AS n FROM budgets JOIN orders ON place <= budget JOIN inc USING (item) GROUP BY ALL),
    m AS (SELECT seed, budget, count(*) AS seen, count(*) FILTER (WHERE n >= 2) AS repeated FROM n GROUP BY ALL)
    SELECT budget, round(avg(seen), 9) AS seen, round(avg(repeated), 9) AS repeated, quantile_cont(seen, 0.025) AS low, quantile_cont(seen, 0.975) AS high FROM m GROUP BY budget""",
)
def coverage_random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What twenty random orders cover at four budgets: means, and the central 95 %."""
    inc = order_incidence(spark, sf_dir)
    orders = shuffled(inc.select("item").distinct(), "item", range(1, 21)).where("rank <= 100")
    n = orders.join(F.broadcast(budget_frame(spark)), F.col("rank") <= F.col("budget")).join(inc, "item").groupBy("seed", "budget", "grp").agg(F.count("*").alias("n"))
    m = n.groupBy("seed", "budget").agg(F.count("*").alias("s"), F.count_if(F.col("n") >= 2).alias("r"))
    low, high = (F.percentile("s", F.lit(q)) for q in (0.025, 0.975))
    return m.groupBy("budget").agg(F.round(F.avg("s"), 9).alias("seen"), F.round(F.avg("r"), 9).alias("repeated"), low.alias("low"), high.alias("high"))


@query(
    "cross_context_coverage",
    f"""WITH {STATIC_SQL}, {CONTEXT_SQL},
    n AS (SELECT budget, grp, context, count(*) AS n FROM budgets JOIN ranked ON rank <= budget JOIN inc USING (item) JOIN ctx USING (item) GROUP BY ALL),
    g AS (SELECT budget, grp, count(*) AS contexts, count(*) FILTER (WHERE n >= 2) AS twice FROM n GROUP BY ALL)
    SELECT budget, count(*) FILTER (WHERE contexts >= 2) AS cross_context, count(*) FILTER (WHERE twice >= 2) AS cross_repeated FROM g GROUP BY budget""",
)
def cross_context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups seen in two contexts, and twice in each of two, at four budgets."""
    order = coverage_static_order(spark, sf_dir).select("rank", "item")
    taken = order.join(F.broadcast(budget_frame(spark)), F.col("rank") <= F.col("budget")).join(order_contexts(spark, sf_dir), "item")
    n = taken.join(order_incidence(spark, sf_dir), "item").groupBy("budget", "grp", "context").agg(F.count("*").alias("n"))
    g = n.groupBy("budget", "grp").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") >= 2).alias("twice"))
    return g.groupBy("budget").agg(F.count_if(F.col("contexts") >= 2).alias("cross_context"), F.count_if(F.col("twice") >= 2).alias("cross_repeated"))


@query(
    "coverage_strata",
    f"""WITH {STATIC_SQL}, groups AS (SELECT grp, count(*) AS df FROM inc GROUP BY grp),
    strata AS (SELECT 'all' AS stratum, grp FROM groups UNION ALL SELECT 'rare', grp FROM groups WHERE df < 350 UNION ALL SELECT 'common', grp FROM groups WHERE df >= 420
        UNION ALL SELECT 'brass', grp FROM groups WHERE grp LIKE '%BRASS%' UNION ALL SELECT 'first brand', grp FROM groups WHERE grp LIKE 'Brand#1%'),
    size AS (SELECT stratum, count(*) AS total FROM strata GROUP BY stratum), grid AS (SELECT budget, stratum, total FROM budgets, size),
    n AS (SELECT budget, grp, count(*) AS n FROM budgets JOIN ranked ON rank <= budget JOIN inc USING (item) GROUP BY ALL),
    s AS (SELECT budget, stratum, count(*) AS seen, count(*) FILTER (WHERE n >= 2) AS repeated FROM n JOIN strata USING (grp) GROUP BY ALL)
    SELECT budget, stratum, total, coalesce(seen, 0) AS seen, coalesce(repeated, 0) AS repeated FROM grid LEFT JOIN s USING (budget, stratum)""",
)
def coverage_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage in overlapping strata of groups; strata of which nothing is seen have zeros."""
    inc = order_incidence(spark, sf_dir)
    groups = inc.groupBy("grp").agg(F.count("*").alias("df"))
    named = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("df") < 350, F.lit("rare")),
            F.when(F.col("df") >= 420, F.lit("common")),
            F.when(F.col("grp").contains("BRASS"), F.lit("brass")),
            F.when(F.col("grp").startswith("Brand#1"), F.lit("first brand")),
        )
    )
    strata = groups.select("grp", F.explode(named).alias("stratum"))
    grid = budget_frame(spark).join(F.broadcast(strata.groupBy("stratum").agg(F.count("*").alias("total"))))
    order = coverage_static_order(spark, sf_dir).select("rank", "item")
    taken = order.join(F.broadcast(budget_frame(spark)), F.col("rank") <= F.col("budget"))
    n = taken.join(inc, "item").groupBy("budget", "grp").agg(F.count("*").alias("n"))
    s = n.join(strata, "grp").groupBy("budget", "stratum").agg(F.count("*").alias("seen"), F.count_if(F.col("n") >= 2).alias("repeated"))
    return grid.join(s, ["budget", "stratum"], "left").na.fill(0, ["seen", "repeated"])


@query(
    "round_robin_order",
    """SELECT s_suppkey, s_nationkey, turn, row_number() OVER (ORDER BY turn, s_nationkey) AS position
    FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier)""",
)
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in turns: the best of each nation, then the second of each."""
    return interleave(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"]).drop("s_acctbal")


@query(
    "first_two_contexts",
    f"""WITH {STATIC_SQL}, {CONTEXT_SQL}, met AS (SELECT grp, context, item, rank FROM ranked JOIN inc USING (item) JOIN ctx USING (item)),
    first AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY grp, context ORDER BY rank) = 1)
    SELECT grp, context, item, row_number() OVER (PARTITION BY grp ORDER BY rank) AS encounter FROM first QUALIFY encounter <= 2""",
)
def first_two_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each group is first met in two different contexts along the static order."""
    inc = order_incidence(spark, sf_dir)
    met = inc.join(static_order(inc), "item").join(order_contexts(spark, sf_dir), "item")
    # The first in the order is the least (-utility, item): an aggregate, where a rank would sort all items in one place.
    place = F.struct((-F.col("utility")).alias("u"), "item")
    first = met.groupBy("grp", "context").agg(F.min(place).alias("place"))
    return top_per_group(first, ["grp"], ["place"], 2, "encounter").select("grp", "context", "place.item", "encounter")


@query(
    "next_batch",
    f"""WITH inc AS ({INCIDENCE_SQL}), full_groups AS (SELECT grp FROM inc WHERE item IN (1, 2, 3) GROUP BY grp HAVING count(*) >= 2)
    SELECT item, count(*) * 0.5::DOUBLE AS gain FROM inc WHERE item NOT IN (1, 2, 3, 4, 5) AND grp NOT IN (SELECT grp FROM full_groups)
    GROUP BY item ORDER BY gain DESC, item LIMIT 5""",
)
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains after a batch of which items 4 and 5 were excluded: they leave the pool and cover nothing."""
    inc = order_incidence(spark, sf_dir)
    covered = inc.where("item IN (1, 2, 3)").groupBy("grp").agg(F.count("*").alias("n"))
    open_groups = inc.where("item NOT IN (1, 2, 3, 4, 5)").join(covered.where("n >= 2"), "grp", "left_anti")
    return gains(open_groups, {}).orderBy(F.desc("gain"), "item").limit(5)
