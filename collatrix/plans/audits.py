"""Audits as queries: examples, contributions, misses and their recovery, order of review, counts of shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.functions.geometry import encode_mask, mask_area
from collatrix.operators import audits as A
from collatrix.operators.graph import connected_components, disconnected_communities, hash_groups
from collatrix.operators.groupstats import exemplars
from collatrix.operators.models import random_partner
from collatrix.operators.vectors import search
from collatrix.plans.graph import near_edges
from collatrix.plans.groupstats import medoid_percentiles
from collatrix.plans.regions import BOX_SQL, regions
from collatrix.plans.registry import query
from collatrix.plans.vectors import asked, items, ranked_sql
from collatrix.sources.tables import table

ROLES = ["1-URGENT", "2-HIGH", "5-LOW"]


@query(
    "role_ordered_examples",
    """WITH o AS (SELECT o_custkey % 50 AS family, o_custkey AS parent, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 9 END AS role_order FROM orders),
    p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY family, parent ORDER BY role_order, id) = 1)
    SELECT family, parent, id, role_order, row_number() OVER (PARTITION BY family ORDER BY role_order, parent) AS nth FROM p QUALIFY nth <= 3""",
)
def role_ordered_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples per family by role, each of another parent."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("family"), F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("role"))
    return A.role_examples(orders, "family", "parent", "role", "id", ROLES).drop("role")


@query(
    "contributing_regions",
    """WITH i AS (SELECT l_orderkey AS photo, l_linenumber::BIGINT AS region, l_suppkey % 10 AS family FROM lineitem),
    a AS (SELECT DISTINCT photo, family FROM i WHERE family = photo % 10), m AS (SELECT i.*, a.family IS NOT NULL AS is_added FROM i LEFT JOIN a USING (photo, family))
    SELECT photo, region, family FROM m QUALIFY is_added OR NOT bool_or(is_added) OVER (PARTITION BY photo)""",
)
def contributing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a photo's new families, or all of its regions if none is new."""
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").cast("long").alias("region"), (F.col("l_suppkey") % 10).alias("family"))
    return A.contributing(held, held.where("family = photo % 10"), "photo", "family").select("photo", "region", "family")


@query(
    "retrieval_audit_rows",
    ranked_sql(1, "a.id <> b.id", asked=True) + " SELECT src, dst, sim, x.family AS family, y.family AS found_family, x.family = y.family AS is_correct FROM ranked JOIN items x ON x.id = src JOIN items y ON y.id = dst",
)
def retrieval_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first retrieval of each query with what it was asked for and what was found."""
    bank = items(spark, sf_dir)
    arms = search(asked(bank), bank, 5).select("src", "dst", "sim", F.when(F.col("rank") == 1, "first").otherwise("rest").alias("arm"))
    sources = bank.select(F.col("id").alias("src"), "family")
    rows = A.audit_rows(arms, "arm", "first", sources, ["src"], expected=asked(bank).count()).drop("arm")
    found = bank.select(F.col("id").alias("dst"), F.col("family").alias("found_family"))
    return rows.join(found, "dst").select("src", "dst", "sim", "family", "found_family", (F.col("family") == F.col("found_family")).alias("is_correct"))


@query(
    "missed_at_rank1",
    ranked_sql(5, "a.id <> b.id", asked=True)
    + """, r AS (SELECT src, dst, rank, x.family = y.family AS is_target FROM ranked JOIN items x ON x.id = src JOIN items y ON y.id = dst)
    SELECT src, dst, rank, is_target FROM r WHERE src IN (SELECT src FROM r WHERE rank = 1 AND NOT is_target)""",
)
def missed_at_rank1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of queries whose first one is of another family."""
    bank = items(spark, sf_dir)
    family = bank.select("id", "family")
    top = search(asked(bank), bank, 5).join(family.select(F.col("id").alias("src"), F.col("family").alias("f")), "src").join(family.select(F.col("id").alias("dst"), F.col("family").alias("g")), "dst")
    top = top.select("src", "dst", "rank", (F.col("f") == F.col("g")).alias("is_target"))
    first = top.where("rank = 1").select("src", F.lit(True).alias("is_visible"), F.col("is_target").alias("is_correct"))
    return A.recovered(first, top, "src").select("src", "dst", "rank", "is_target")


FAMILIES_SQL = "f AS (SELECT c_nationkey AS family, count(DISTINCT c_mktsegment) AS parents, CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE round(median(c_acctbal), 4) END AS similarity FROM customer GROUP BY c_nationkey)"


@query("family_review_order", f"WITH {FAMILIES_SQL} SELECT family, parents, similarity, row_number() OVER (ORDER BY parents DESC, coalesce(similarity, -1) DESC, family) AS position FROM f")
def family_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by how many parents they have, then by their median."""
    median = F.round(F.percentile("c_acctbal", F.lit(0.5)), 4)
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("family")).agg(F.countDistinct("c_mktsegment").alias("parents"), median.alias("m"))
    f = f.select("family", "parents", F.when(F.col("family") % 7 != 0, F.col("m")).alias("similarity"))
    return A.family_order(f, "family", "parents", "similarity")


@query("shape_counts", f"WITH {BOX_SQL} SELECT (x1 - x0)::BIGINT AS wide, (y1 - y0)::BIGINT AS high, count(*) AS n FROM reg GROUP BY ALL")
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions have which shape."""
    r = regions(spark, sf_dir).select((F.col("x1") - F.col("x0")).cast("long").alias("wide"), (F.col("y1") - F.col("y0")).cast("long").alias("high"))
    return r.groupBy("wide", "high").agg(F.count("*").alias("n"))


@query("pivot_boolean", "SELECT user_id, coalesce(bool_or(event_type = 'click'), false) AS click, coalesce(bool_or(event_type = 'view'), false) AS view, coalesce(bool_or(event_type = 'purchase'), false) AS purchase FROM events GROUP BY user_id")
def pivot_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user has each type of event, a column per type."""
    kinds = ["click", "view", "purchase"]
    wide = table(spark, sf_dir, "events").select("user_id", "event_type").distinct().groupBy("user_id").pivot("event_type", kinds).agg(F.first(F.lit(True)))
    return wide.select("user_id", *[F.coalesce(k, F.lit(False)).alias(k) for k in kinds])


@query("mask_areas", "SELECT DISTINCT l_quantity::BIGINT AS wide, l_linenumber::BIGINT AS high, (l_quantity * l_linenumber)::BIGINT AS pixels FROM lineitem")
def mask_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as masks in run-length code, and their area from the code."""
    @F.pandas_udf("string")
    def code(wide: pd.Series, high: pd.Series) -> pd.Series:
        masks = [np.zeros((h + 2, w + 3), dtype=np.uint8) for w, h in zip(wide, high, strict=True)]
        for m in masks:
            m[1:-1, 2:-1] = 1
        return pd.Series([encode_mask(m) for m in masks])

    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("wide"), F.col("l_linenumber").cast("long").alias("high")).distinct()
    return boxes.select("wide", "high", mask_area(code("wide", "high")).alias("pixels"))


SCENE_SQL = """(('0x' || substr(md5((c_custkey // 4)::VARCHAR), 1, 15))::BIGINT)"""
FLIPS_SQL = "xor(xor((1::BIGINT << (c_custkey % 7)::INT), (1::BIGINT << (20 + c_custkey % 5)::INT)), CASE WHEN c_custkey % 11 = 0 THEN 255::BIGINT << 40 ELSE 0 END)"
HASHES_SQL = f"h AS (SELECT c_custkey AS id, xor({SCENE_SQL}, {FLIPS_SQL}) AS h FROM customer)"


@query(
    "near_duplicate_scenes",
    f"""WITH RECURSIVE {HASHES_SQL}, e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 5),
    reach(node, root) AS (SELECT id, id FROM h UNION SELECT b, root FROM reach JOIN e ON a = node), r AS (SELECT node, min(root) AS scene FROM reach GROUP BY node)
    SELECT scene, count(*) AS members FROM r GROUP BY scene""",
)
def near_duplicate_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of photos whose perceptual hashes, made here from a digest with flipped bits, differ in five bits at most."""
    key = F.col("c_custkey").cast("long")
    scene = F.conv(F.substring(F.md5(F.floor(key / 4).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    flips = F.expr("shiftleft(1L, CAST(c_custkey % 7 AS INT)) ^ shiftleft(1L, CAST(20 + c_custkey % 5 AS INT)) ^ IF(c_custkey % 11 = 0, shiftleft(255L, 40), 0L)")
    hashed = table(spark, sf_dir, "customer").select(key.alias("id"), scene.bitwiseXOR(flips).alias("h"))
    return hash_groups(hashed, "id", "h").groupBy(F.col("group").alias("scene")).agg(F.count("*").alias("members"))


@query(
    "community_connectivity",
    ranked_sql(2).replace("WITH", "WITH RECURSIVE", 1)
    + """, both_ways AS (SELECT x.src AS a, x.dst AS b FROM ranked x JOIN ranked y ON x.src = y.dst AND x.dst = y.src WHERE x.src_family = x.dst_family),
    reach(node, root) AS (SELECT id, id FROM items UNION SELECT b, root FROM reach JOIN both_ways ON a = node), r AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT family AS label, count(DISTINCT root) AS pieces FROM r JOIN items ON id = node GROUP BY family HAVING count(DISTINCT root) > 1""",
)
def community_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that fall apart when only near edges inside them are left, and into how many pieces."""
    labels = items(spark, sf_dir).select(F.col("id").alias("node"), F.col("family").alias("label"))
    return disconnected_communities(near_edges(spark, sf_dir), labels)


@query("exemplar_roles")
def exemplar_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six items per family in different roles, by similarity to the medoid, degree and size."""
    degree = connected_components(near_edges(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("degree"))
    near = medoid_percentiles(spark, sf_dir).join(items(spark, sf_dir).select("id", "parent"), "id")
    rows = near.join(degree, near["id"] == degree["root"], "left")
    return exemplars(
        rows.select(F.col("family").alias("grp"), "id", "parent", F.coalesce("degree", F.lit(0)).cast("double").alias("degree"), (F.col("id") % 97).cast("double").alias("size"), (1 - F.col("sim")).alias("distance"), F.col("percentile").alias("affinity"), (F.col("percentile") == 1).alias("is_medoid"))
    )


@query("random_negatives")
def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partner of another parent for every item, the same in every run."""
    return random_partner(items(spark, sf_dir), "id", "parent")

