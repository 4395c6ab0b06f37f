"""Group statistics: shares, entropy, medoids, percentiles, set similarities, partition agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.session import materialize


def shares(df: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, kind, n, share) of kinds in groups."""
    counted = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def entropy(df: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, kinds, largest_share, entropy): entropy over its greatest value, 0 for a single kind."""
    s = shares(df, group, kind)
    grouped = s.groupBy(group).agg(F.count("*").alias("kinds"), F.max("share").alias("largest_share"), (-F.sum(F.col("share") * F.log("share"))).alias("h"))
    return grouped.select(group, "kinds", "largest_share", F.when(F.col("kinds") > 1, F.col("h") / F.log(F.col("kinds").cast("double"))).otherwise(F.lit(0.0)).alias("entropy"))


def idf_weights(incidence: DataFrame, n_items: int, cap: float = 3.0) -> DataFrame:
    """(grp, df, weight) from distinct (item, grp): ln((N + 1) / (df + 1)) + 1, at most ``cap``."""
    df = incidence.groupBy("grp").agg(F.count("*").alias("df"))
    return df.withColumn("weight", F.least(F.lit(cap), F.log(F.lit(n_items + 1.0) / (F.col("df") + 1)) + 1))


def cooccurrence(incidence: DataFrame) -> DataFrame:
    """(a, b, n): in how many items two groups are together."""
    x, y = incidence.select("item", F.col("grp").alias("a")), incidence.select("item", F.col("grp").alias("b"))
    return x.join(y, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


#: Sets of up to so many groups are found by three common groups, or by two; larger ones by one.
THREE_MOST, TWO_MOST = 16, 64


def _keys(level: int, slack: Column) -> Column:
    """The first ``level`` groups that a set can have in common with a similar one: those with no more than ``slack`` skipped before the last.

    Needs the columns ``set`` and ``cum``, the weight before each place.
    """
    places = F.sequence(F.lit(0), F.size("set") - 1)
    weight = lambda i: -F.get("set", i)["w"]
    group = lambda i: F.get("set", i)["grp"]
    fits = lambda last, *first: F.get("cum", last) - sum((weight(i) for i in first), F.lit(0.0)) <= slack
    if level == 1:
        return F.transform(F.filter(places, lambda i: fits(i)), lambda i: F.array(group(i)))
    if level == 2:
        after = lambda i: F.transform(F.filter(places, lambda j: (j > i) & fits(j, i)), lambda j: F.array(group(i), group(j)))
        return F.flatten(F.transform(F.filter(places, lambda i: fits(i)), after))

    def pairs(i: Column) -> Column:
        third = lambda j: F.transform(F.filter(places, lambda k: (k > j) & fits(k, i, j)), lambda k: F.array(group(i), group(j), group(k)))
        return F.flatten(F.transform(F.filter(places, lambda j: (j > i) & fits(j, i)), third))

    return F.flatten(F.transform(F.filter(places, lambda i: fits(i)), pairs))


def weighted_jaccard(incidence: DataFrame, weights: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of items by the weighted Jaccard similarity of their group sets.

    ``classes`` is (item, class_id): items with the same set are a class, named by the
    least item. ``links`` is (a, b, similarity) with a < b, between classes, of ``least`` or more.

    What a set does not share with one so similar weighs at most 1 - ``least`` of it, so the first
    common groups (heaviest first, alike in all sets) are among few combinations of it. A set's level is how many
    groups it has in common with a similar one at least, up to three; two sets meet at the lower of their
    levels, on as many groups and a class of total weight, and are judged where these are the first they share.
    """
    weighed = incidence.join(weights.select("grp", "weight"), "grp")
    sets = weighed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "grp"))).alias("set"))
    named = sets.groupBy("set").agg(F.min("item").alias("class_id"))
    classes = sets.join(named, "set").select("item", "class_id")
    until = lambda i: -F.aggregate(F.slice("set", F.lit(1), i), F.lit(0.0), lambda s, x: s + x["w"])
    total = F.element_at("cum", -1)
    n = F.size("set")
    summed = named.withColumn("cum", F.transform(F.sequence(F.lit(0), n), until)).withColumn("total", total)
    least_common = F.size(F.filter("cum", lambda c: c < F.lit(least) * F.col("total") - 1e-9))
    level = F.greatest(F.least(least_common, F.when(n <= THREE_MOST, 3).when(n <= TWO_MOST, 2).otherwise(1)), F.lit(1))
    # Totals of similar sets are in the same class or in neighbouring ones.
    size_class = F.floor(F.log(F.col("total")) / F.lit(1e-6 - math.log(least))).cast("int")
    leveled = materialize(summed.select("class_id", "set", "cum", "total", level.alias("own_level"), size_class.alias("size")), "sets")
    slack = F.lit(1 - least) * F.col("total") + 1e-9
    opened = None
    for k in (1, 2, 3):
        rows = leveled.where(F.col("own_level") >= k).select("class_id", "set", "total", "own_level", "size", F.lit(k).alias("level"), F.explode(_keys(k, slack)).alias("key"))
        opened = rows if opened is None else opened.unionByName(rows)
    x = opened.where("own_level = level").select("level", "key", "size", *[F.col(c).alias(f"{c}_a") for c in ("class_id", "set", "total")])
    near = F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("size")
    y = opened.select("level", "key", near, (F.col("own_level") == F.col("level")).alias("both_own"), *[F.col(c).alias(f"{c}_b") for c in ("class_id", "set", "total")])
    pairs = x.join(y, ["level", "key", "size"]).where("class_id_a <> class_id_b AND (NOT both_own OR class_id_a < class_id_b)")
    both = F.col("total_a") + F.col("total_b")
    pairs = pairs.where(F.least("total_a", "total_b") >= F.lit(least) * F.greatest("total_a", "total_b") - 1e-9)
    shared = F.array_intersect("set_a", "set_b")
    pairs = pairs.withColumn("shared", shared).where(F.transform(F.slice("shared", F.lit(1), F.col("level")), lambda z: z["grp"]) == F.col("key"))
    common = -F.aggregate("shared", F.lit(0.0), lambda s, z: s + z["w"])
    judged = pairs.select(F.least("class_id_a", "class_id_b").alias("a"), F.greatest("class_id_a", "class_id_b").alias("b"), common.alias("common"), both.alias("both"))
    links = judged.select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    return classes, links


def max_jaccard(main: DataFrame, other: DataFrame) -> DataFrame:
    """(label, best): each group of one partition against its most similar group of another.

    Both are (node, label); a negative label means none: it is no group of the other
    partition, but its nodes still count in the size of the main group.
    """
    size = main.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))
    others = other.where("label >= 0").withColumnRenamed("label", "other")
    other_size = others.groupBy("other").agg(F.count("*").alias("m"))
    both = main.where("label >= 0").join(others, "node").groupBy("label", "other").agg(F.count("*").alias("k"))
    scored = both.join(size, "label").join(other_size, "other").withColumn("j", F.col("k") / (F.col("n") + F.col("m") - F.col("k")))
    best = scored.groupBy("label").agg(F.max("j").alias("best"))
    return size.join(best, "label", "left").select("label", "n", F.coalesce("best", F.lit(0.0)).alias("best"))


def adjusted_rand(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row with the adjusted Rand index of two labellings of the same rows."""
    twice = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    cells = pairs.groupBy(x, y).agg(F.count("*").alias("n")).agg(F.sum(twice("n")).alias("both"), F.sum("n").alias("rows"))
    rows = pairs.groupBy(x).agg(F.count("*").alias("n")).agg(F.sum(twice("n")).alias("rx"))
    cols = pairs.groupBy(y).agg(F.count("*").alias("n")).agg(F.sum(twice("n")).alias("ry"))
    one = cells.crossJoin(rows).crossJoin(cols)
    every = twice("rows")
    expected = F.col("rx") * F.col("ry") / every
    spread = (F.col("rx") + F.col("ry")) / 2 - expected
    return one.select(F.when((F.col("rows") < 2) | (spread == 0), F.lit(1.0)).otherwise((F.col("both") - expected) / spread).alias("ari"))


def cume_percentile(value: Column | str, group: str) -> Column:
    """The share of a group's values that are not greater."""
    return F.cume_dist().over(W.partitionBy(group).orderBy(value))


def average_rank(value: str, group: str) -> Column:
    """The average rank of a value in its group, over the group's size."""
    ranked = F.rank().over(W.partitionBy(group).orderBy(value))
    peers = F.count("*").over(W.partitionBy(group, value))
    return (ranked + (peers - 1) / F.lit(2.0)) / F.count("*").over(W.partitionBy(group))


def count_histogram(df: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have how many rows."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def exemplars(members: DataFrame, group: str = "grp") -> DataFrame:
    """(group, role, id): distinct members in six roles, chosen in this order.

    ``members`` has (group, id, parent, degree, size, distance, affinity, is_medoid). Each role takes the best
    member not taken yet, if possible of a parent not taken yet; the group is one array of its own.
    """
    import pandas as pd

    roles = (("medoid", "is_medoid", -1), ("hub", "degree", -1), ("smallest", "size", 1), ("largest", "size", -1), ("farthest", "distance", -1), ("weakest", "affinity", 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, taken, parents = pdf.to_dict("records"), set(), set()
        several, out = pdf["parent"].nunique() >= len(roles), []
        for name, column, sign in roles:
            free = [r for r in rows if r["id"] not in taken and not (several and r["parent"] in parents)]
            if free:
                best = min(free, key=lambda r: (sign * float(r[column]), r["id"]))  # noqa: B023
                taken.add(best["id"])
                parents.add(best["parent"])
                out.append((best[group], name, best["id"]))
        return pd.DataFrame(out, columns=[group, "role", "id"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    return members.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, role string, id {kinds['id']}")


def core_and_edge(members: DataFrame, group: str, value: str, key: str, core: int = 4, edge: int = 3, spread: int = 4, most: int = 8) -> DataFrame:
    """(group, key, kind): the members nearest to the centre, farthest from it, and some by a hash; each once, ``most`` in all."""
    place = lambda *order: F.row_number().over(W.partitionBy(group).orderBy(*order))
    ranked = members.select(group, key, place(F.desc(value), key).alias("near"), place(F.asc(value), key).alias("far"), place(F.xxhash64(key), key).alias("any"))
    kind = F.when(F.col("near") <= core, 0).when(F.col("far") <= edge, 1).when(F.col("any") <= spread, 2)
    kept = ranked.withColumn("kind", kind).where("kind IS NOT NULL")
    first = kept.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("kind", "near"))).where(F.col("n") <= most)
    return first.select(group, key, F.element_at(F.array(F.lit("core"), F.lit("edge"), F.lit("spread")), F.col("kind") + 1).alias("kind"))
