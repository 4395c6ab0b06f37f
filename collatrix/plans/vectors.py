"""Vector queries over the embedding bank: an item's parent is its id modulo 50, its family its label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.functions.scalar import dot, unit
from collatrix.operators.ingest import best_per_group, top_per_group
from collatrix.operators.pairs import pair_sims, ranked_pairs
from collatrix.operators.vectors import DIGITS, group_distinct, prefer_context, rounded, search
from collatrix.plans.registry import query
from collatrix.session import materialize
from collatrix.sources.tables import table

#: Searches ask for every item whose id is divisible by this, against all items.
QUERY_STEP = 20


def items(spark: SparkSession, sf_dir: str, half: bool = False) -> DataFrame:
    """(id, parent, family, v); with ``half``, v is the second half of the vector, another view."""
    v = F.slice("embedding", 33, 32) if half else F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("parent"), F.col("label").cast("long").alias("family"), v.cast("array<double>").alias("v"))


def asked(bank: DataFrame) -> DataFrame:
    return bank.where(F.col("id") % QUERY_STEP == 0)


ITEMS_SQL = "items AS (SELECT vec_id AS id, vec_id % 50 AS parent, label::BIGINT AS family, embedding::DOUBLE[] AS v FROM embeddings)"


def sims_sql(condition: str, asked: bool = True, vector: str = "v") -> str:
    where = f" AND a.id % {QUERY_STEP} = 0" if asked else ""
    x, y = (f"{t}.v[33:64]" if vector == "half" else f"{t}.v" for t in "ab")
    return f"""sims AS (SELECT a.id AS src, a.parent AS src_parent, a.family AS src_family, b.id AS dst, b.parent AS dst_parent, b.family AS dst_family,
        round(list_dot_product({x}, {y}), {DIGITS}) AS sim FROM items a JOIN items b ON {condition}{where})"""


def ranked_sql(k: int, condition: str = "a.parent <> b.parent", asked: bool = False, vector: str = "v") -> str:
    return f"""WITH {ITEMS_SQL}, {sims_sql(condition, asked, vector)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= {k})"""


@query("knn_top5", ranked_sql(5, "a.id <> b.id", asked=True) + " SELECT src, dst, sim, rank FROM ranked")
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest items of each query item."""
    bank = items(spark, sf_dir)
    return search(asked(bank), bank, 5).select("src", "dst", "sim", "rank")


DISTINCT_SQL = f"""WITH {ITEMS_SQL}, {sims_sql("a.parent <> b.parent")},
    per AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY src, dst_parent ORDER BY sim DESC, dst) = 1)
    SELECT src, dst, dst_parent, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM per QUALIFY rank <= 15"""


@query("knn_group_distinct", DISTINCT_SQL)
def knn_group_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best item of each other parent, for the 15 nearest parents."""
    bank = items(spark, sf_dir)
    return group_distinct(search(asked(bank), bank, 1, "parent", "parent"), 15).select("src", "dst", "dst_parent", "sim", "rank")


@query(
    "in_family_top3",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.family = b.family AND a.parent <> b.parent")}
    SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= 3""",
)
def in_family_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest items of the same family and another parent."""
    bank = items(spark, sf_dir)
    found = search(asked(bank), bank, 3, "parent", "family")
    own = asked(bank).select(F.col("id").alias("src"), "family")
    return found.join(own, "src").where("dst_family = family").select("src", "dst", "sim", "rank")


@query(
    "cross_context_candidates",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.parent <> b.parent")},
    picked AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY src, dst_family
        ORDER BY (src_parent % 5 <> dst_parent % 5)::INT DESC, sim DESC, dst) = 1)
    SELECT src, dst, dst_family, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM picked QUALIFY rank <= 5""",
)
def cross_context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best item of each family, preferably from another context; the five best families."""
    bank = items(spark, sf_dir)
    best = search(asked(bank), bank, 1, "parent", "family")
    by_context = bank.withColumn("parent", F.col("parent") % 5)
    across = search(asked(by_context), by_context, 1, "parent", "family")
    picked = prefer_context(best, across)
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return picked.withColumn("rank", rank).where("rank <= 5").select("src", "dst", "dst_family", "sim", "rank")


@query(
    "family_maxsim_rank",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.parent <> b.parent")},
    best AS (SELECT src, src_family, dst_family, max(sim) AS score FROM sims GROUP BY ALL)
    SELECT src, dst_family AS family, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst_family) AS rank, src_family = dst_family AS expected FROM best""",
)
def family_maxsim_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of each query by their most similar member."""
    bank = items(spark, sf_dir)
    best = search(asked(bank), bank, 1, "parent", "family")
    own = asked(bank).select(F.col("id").alias("src"), F.col("family").alias("own"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst_family"))
    return best.join(own, "src").select("src", F.col("dst_family").alias("family"), F.col("sim").alias("score"), rank.alias("rank"), (F.col("dst_family") == F.col("own")).alias("expected"))


CENTROID_SQL = f"""WITH {ITEMS_SQL},
    long AS (SELECT id, family, unnest(v) AS x, unnest(range(64)) AS i FROM items),
    mean AS (SELECT family, i, avg(x) AS x FROM long GROUP BY family, i),
    centre AS (SELECT family, list(x ORDER BY i) AS c FROM mean GROUP BY family)
    SELECT id, family, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) AS sim,
        row_number() OVER (PARTITION BY family ORDER BY round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) DESC, id) AS rank
    FROM items JOIN centre USING (family)"""


@query("centroid_order", CENTROID_SQL)
def centroid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each family by similarity to its centroid."""
    bank = items(spark, sf_dir)
    mean = bank.select("family", F.posexplode("v").alias("i", "x")).groupBy("family", "i").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    centre = centre.select("family", unit(F.transform("c", lambda s: s["x"])).alias("c"))
    scored = bank.join(F.broadcast(centre), "family").select("id", "family", F.round(dot(F.col("v"), F.col("c")), DIGITS).alias("sim"))
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("sim"), "id"))
    return scored.select("id", "family", "sim", rank.alias("rank"))


PAIRS_SQL = f"""WITH {ITEMS_SQL}, {sims_sql("a.family = b.family AND a.parent <> b.parent AND a.parent % 5 <> b.parent % 5 AND a.id < b.id", asked=False)},
    three AS (SELECT src, dst, src_family AS family, sim,
        round(list_dot_product(x.v[1:32], y.v[1:32]), 9) AS first_half, round(list_dot_product(x.v[33:64], y.v[33:64]), 9) AS second_half
        FROM sims JOIN items x ON x.id = src JOIN items y ON y.id = dst),
    ranked AS (SELECT *, {{ranks}} FROM three)"""
RANKS_SQL = ", ".join(
    f"(rank() OVER (PARTITION BY family ORDER BY {v}) + (count(*) OVER (PARTITION BY family, {v}) - 1) / 2.0) / count(*) OVER (PARTITION BY family) AS r{i}" for i, v in enumerate(("sim", "first_half", "second_half"))
)
PAIRS_SQL = PAIRS_SQL.format(ranks=RANKS_SQL)


def in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their context; pairs of a family are those of different contexts."""
    return items(spark, sf_dir).withColumn("context", F.col("parent") % 5)


def least_and_mean(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rounded(ranks.min(axis=0)), rounded((ranks[0] + ranks[1] + ranks[2]) / 3)


@query("average_rank_pairs", PAIRS_SQL + " SELECT src, dst, family, round(least(r0, r1, r2), 9) AS min_rank, round((r0 + r1 + r2) / 3, 9) AS mean_rank FROM ranked")
def average_rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and mean of the three average ranks of each pair."""

    def make(src, dst, family, sims, ranks):
        low, mean = least_and_mean(ranks)
        return pd.DataFrame({"src": src, "dst": dst, "family": family, "min_rank": low, "mean_rank": mean})

    return ranked_pairs(in_context(spark, sf_dir), make, "src long, dst long, family long, min_rank double, mean_rank double")


@query(
    "consensus_pair_selection",
    PAIRS_SQL
    + """, scored AS (SELECT *, round(least(r0, r1, r2), 9) AS lo, round((r0 + r1 + r2) / 3, 9) AS mid FROM ranked)
    SELECT 'consensus' AS method, family, src, dst FROM scored QUALIFY row_number() OVER (PARTITION BY family ORDER BY lo DESC, mid DESC, sim DESC, src, dst) = 1
    UNION ALL SELECT 'nearest', family, src, dst FROM scored QUALIFY row_number() OVER (PARTITION BY family ORDER BY sim DESC, src, dst) = 1""",
)
def consensus_pair_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of each family that all views agree on most, and the nearest one."""

    def make(src, dst, family, sims, ranks):
        low, mean = least_and_mean(ranks)
        sim = np.where(np.isnan(sims[0]), -np.inf, sims[0])
        rows = []
        for method, order in (("consensus", (low, mean, sim, -src, -dst)), ("nearest", (sim, -src, -dst))):
            at = np.arange(len(src))
            for key in order:
                at = at[key[at] == key[at].max()] if len(at) else at
            rows += [(method, family, src[x], dst[x], low[x], mean[x], sim[x]) for x in at[:1]]
        return pd.DataFrame(rows, columns=["method", "family", "src", "dst", "lo", "mid", "sim"])

    # Each two blocks give their own best pairs; the best of these are the best of all.
    best = materialize(ranked_pairs(in_context(spark, sf_dir), make, "method string, family long, src long, dst long, lo double, mid double, sim double"), "best")
    consensus = best_per_group(best.where("method = 'consensus'"), ["family"], [F.desc("lo"), F.desc("mid"), F.desc("sim"), "src", "dst"])
    nearest = best_per_group(best.where("method = 'nearest'"), ["family"], [F.desc("sim"), "src", "dst"])
    return consensus.unionByName(nearest).select("method", "family", "src", "dst")


@query(
    "pair_features",
    PAIRS_SQL
    + """ SELECT src, dst, least(sim, first_half, second_half) AS lowest, greatest(sim, first_half, second_half) AS highest, m AS mean,
    sqrt(((sim - m) * (sim - m) + (first_half - m) * (first_half - m) + (second_half - m) * (second_half - m)) / 3) AS spread, abs(first_half - second_half) AS gap
    FROM (SELECT *, (sim + first_half + second_half) / 3 AS m FROM ranked)""",
)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of pairs from three views: least, greatest, mean, spread and gap."""
    s = [F.col(c) for c in ("sim", "first_half", "second_half")]
    pairs = pair_sims(in_context(spark, sf_dir)).withColumn("m", (s[0] + s[1] + s[2]) / 3)
    off = [(x - F.col("m")) * (x - F.col("m")) for x in s]
    return pairs.select(
        "src",
        "dst",
        F.least(*s).alias("lowest"),
        F.greatest(*s).alias("highest"),
        F.col("m").alias("mean"),
        F.sqrt((off[0] + off[1] + off[2]) / 3).alias("spread"),
        F.abs(s[1] - s[2]).alias("gap"),
    )


@query(
    "neighbor_dereference",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.id <> b.id")},
    top AS (SELECT src, src_parent, src_family, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= 5)
    SELECT src, dst, rank, i.parent AS dst_parent, i.family AS dst_family, i.family = src_family AS same_family, i.parent % 5 = src_parent % 5 AS same_context
    FROM top JOIN items i ON i.id = dst WHERE dst % 7 <> 0""",
)
def neighbor_dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of neighbours opened into rows with the neighbours' own columns; unknown ids fall out."""
    bank = items(spark, sf_dir)
    lists = search(asked(bank), bank, 5).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("neighbors"))
    opened = lists.select("src", F.posexplode("neighbors").alias("at", "x")).select("src", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.dst").alias("dst"))
    known = bank.where("id % 7 <> 0").select(F.col("id").alias("dst"), F.col("parent").alias("dst_parent"), F.col("family").alias("dst_family"))
    own = bank.select(F.col("id").alias("src"), F.col("parent").alias("sp"), F.col("family").alias("sf"))
    named = opened.join(known, "dst").join(own, "src")
    return named.select("src", "dst", "rank", "dst_parent", "dst_family", (F.col("dst_family") == F.col("sf")).alias("same_family"), (F.col("dst_parent") % 5 == F.col("sp") % 5).alias("same_context"))


@query(
    "knn_transfer",
    f"""WITH {ITEMS_SQL}, {sims_sql("a.id <> b.id")},
    top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5),
    votes AS (SELECT src, src_family, dst_family, round(sum(sim), 9) AS weight FROM top GROUP BY ALL)
    SELECT src, dst_family AS predicted, src_family = dst_family AS correct FROM votes
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst_family) = 1""",
)
def knn_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family for each query from its five nearest items, weighed by similarity."""
    bank = items(spark, sf_dir)
    votes = search(asked(bank), bank, 5).groupBy("src", "dst_family").agg(F.round(F.sum("sim"), 9).alias("weight"))
    best = best_per_group(votes, ["src"], [F.desc("weight"), "dst_family"])
    own = bank.select(F.col("id").alias("src"), "family")
    return best.join(own, "src").select("src", F.col("dst_family").alias("predicted"), (F.col("dst_family") == F.col("family")).alias("correct"))


@query(
    "family_listing",
    f"""WITH {ITEMS_SQL} SELECT family, count(*) AS members, count(DISTINCT parent) AS parents FROM items GROUP BY family ORDER BY parents DESC, family""",
)
def family_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by the number of parents."""
    return items(spark, sf_dir).groupBy("family").agg(F.count("*").alias("members"), F.countDistinct("parent").alias("parents")).orderBy(F.desc("parents"), "family")


@query(
    "family_page",
    f"""WITH {ITEMS_SQL} SELECT id, parent, count(*) OVER () AS total, row_number() OVER (ORDER BY (id % 3 = 0) DESC, parent DESC, id) AS position
    FROM items WHERE family = 3 QUALIFY position BETWEEN 6 AND 15""",
)
def family_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten, after five, of a family's items: core ones first; with the total."""
    core = (F.col("id") % 3 == 0).cast("int")
    own = items(spark, sf_dir).where("family = 3").select("id", "parent", "family", core.alias("core"))
    placed = top_per_group(own.withColumn("total", F.count("*").over(W.partitionBy("family"))), ["family"], [F.desc("core"), F.desc("parent"), "id"], 15, "position")
    return placed.where("position > 5").select("id", "parent", "total", "position")


@query(
    "catalog_batch",
    f"""WITH {ITEMS_SQL}, picked(pos, id) AS (VALUES (0, 40), (1, 7), (2, 40), (3, 90), (4, 11), (5, 57)),
    first AS (SELECT id, min(pos) AS pos FROM picked GROUP BY id)
    SELECT parent, min(pos) AS first_seen, string_agg(id::VARCHAR, ';' ORDER BY pos) AS ids,
    CASE WHEN bool_or(id % 3 = 0) THEN 'supported' ELSE 'candidate' END AS status
    FROM first JOIN items USING (id) GROUP BY parent""",
)
def catalog_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of a list of items in the order they were first named, with their items."""
    picked = spark.createDataFrame([(0, 40), (1, 7), (2, 40), (3, 90), (4, 11), (5, 57)], "pos int, id long")
    first = picked.groupBy("id").agg(F.min("pos").alias("pos"))
    named = items(spark, sf_dir).select("id", "parent").join(F.broadcast(first), "id")
    grouped = named.groupBy("parent").agg(F.min("pos").alias("first_seen"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"), F.bool_or(F.col("id") % 3 == 0).alias("core"))
    ids = F.array_join(F.transform("x", lambda s: s["id"].cast("string")), ";")
    return grouped.select("parent", "first_seen", ids.alias("ids"), F.when(F.col("core"), "supported").otherwise("candidate").alias("status"))
