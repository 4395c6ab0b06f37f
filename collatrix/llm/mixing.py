"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in an order shuffled by a hash of their id, and
pass up to ``max_passes`` times. An instance's virtual finish time is the source's
tokens up to and with it, divided by the source's weight. All instances of all
sources are dealt by ranges of that time, and the queue is cut where the
running total of tokens would pass the budget: the tokens of all documents. Ranges
before the cut are taken whole; only the range with the cut is summed row by row.
Sources that run out are served less than their weight, and the others get their part.

``target`` is where a queue of infinitely small documents would end, from a row per
source; it decides nothing, and what is taken differs from it by a few documents.

A running sum over a hot source would be one task, so a source is dealt into
``BUCKETS`` ranges of the hash: sums of ranges give each range its offset, and
the running sum is over one range.

Defined cases: a null text has size 0, and documents of size 0 are never taken;
a null source is a source of its own, after all others; null ids are shuffled
by their text; rows that repeat stand beside each other and each counts; an
empty table gives an empty result. ``queue`` leaves other columns out, ``mix`` keeps
all, and its own columns get underscores after their names where the rows have these already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.llm.store import count_words, documents, materialize
from collatrix.operators.ranking import in_order

#: Ranges of the shuffling hash in each source: three hexadecimal digits.
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS


def source_targets(sizes: DataFrame, weights: Sequence[int], max_passes: int) -> tuple[DataFrame, int]:
    """Targets per source, (skey, source_size, weight, target) from (skey, source_size), and the total size.

    Water filling: sources by max_passes * size / weight; the first of them are
    full as long as their share of what is left reaches that. Sources can be many (domains), so their
    order and sums go through ranges too.
    """
    nth = in_order(sizes, ["skey"], rank="nth")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = nth.select("skey", "source_size", w.alias("w"), (F.col("source_size") * max_passes).alias("most"))
    placed = in_order(weighed, [(F.col("most") / F.col("w")).asc(), F.col("skey").asc()], running={"most_until": "most", "w_until": "w"}, rank="rank")
    sums = weighed.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weights")).first()
    total, all_weights = sums["total"] or 0, sums["weights"] or 0
    wide = lambda c: c.cast("decimal(19,0)")
    ranked = placed.withColumns({"left": F.lit(total) - F.col("most_until") + F.col("most"), "open_w": F.lit(all_weights) - F.col("w_until") + F.col("w")})
    ranked = ranked.withColumn("full", wide(F.col("most")) * wide(F.col("open_w")) <= wide(F.col("w")) * wide(F.col("left")))
    first_open = ranked.where(~F.col("full")).agg(F.min(F.struct("rank", "left", "open_w")).alias("x")).first()["x"]
    share = F.col("w") * F.lit(first_open["left"]) / F.lit(first_open["open_w"]) if first_open else F.lit(0.0)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)
    return ranked.select("skey", "source_size", F.col("w").alias("weight"), target.alias("target")), total


def first_beyond(instances: DataFrame, budget: int) -> tuple | None:
    """(finish, skey, until) of the first instance with which the running total of tokens passes the budget, or None.

    Instances (finish, skey, until, size) are sorted into ranges; the totals of ranges, a row
    each, tell the one with the cut.
    """
    order = ["finish", "skey", "until"]
    ranged = materialize(instances.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "instances")
    before = 0
    for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect():
        if before + r["size"] > budget:
            running = F.sum("size").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
            beyond = ranged.where(F.col("range") == r["range"]).withColumn("running", running).where(F.col("running") > budget - before)
            return tuple(beyond.orderBy(*order).select(*order).first())
        before += r["size"]
    return None


def queue(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_passes: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", ident: Sequence[Column] = ()) -> DataFrame:
    """Per document its key, source, size, until (tokens up to and with it in a pass), source_size, weight, target and copies taken.

    ``weights`` go to the sources in code-point order, null last, over and over.
    ``ident`` are further columns that are carried, and settle the order of rows of one key and size.
    """
    carried = [f"ident_{i}" for i in range(len(ident))]
    named = F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.when(F.col(source).isNull(), "~").otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("skey"),
        count_words(F.col(text)).alias("size"),
        F.md5(named.cast("binary")).alias("h"),
        *[c.alias(name) for c, name in zip(ident, carried, strict=True)],
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    rows = materialize(rows, "mixing")
    ranges = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("range_size"))
    targets, total = source_targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")), weights, max_passes)
    offset = F.coalesce(F.sum("range_size").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("skey", "bucket", offset.alias("offset")).join(targets, "skey")
    within = W.partitionBy("skey", "bucket").orderBy("h", "key", "size", *carried).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("in_range", F.sum("size").over(within))
    timed = summed.join(placed, ["skey", "bucket"]).withColumn("until", F.col("offset") + F.col("in_range"))
    timed = materialize(timed.select("key", "source", "skey", "size", "until", "source_size", "weight", "target", *carried), "timed")
    each = timed.where("size > 0").select("skey", "size", "weight", F.explode(passes(max_passes)).alias("until"))
    cut = first_beyond(each.select((F.col("until") / F.col("weight")).alias("finish"), "skey", "until", "size"), total)
    taken = F.size(F.filter(passes(max_passes), lambda until: is_before(until, cut)))
    return timed.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0)).drop("skey")


def passes(n: int) -> Column:
    """Tokens of the source up to and with each instance of a document."""
    return F.array(*[F.col("until") + p * F.col("source_size") for p in range(n)])


def is_before(until: Column, cut: tuple | None) -> Column:
    """Whether an instance is before the cut in the order of the queue."""
    if cut is None:
        return F.lit(True)
    finish, skey, tokens = cut
    own = until / F.col("weight")
    return (own < finish) | ((own == finish) & ((F.col("skey") < skey) | ((F.col("skey") == skey) & (until < tokens))))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_passes: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each taken instance of a document, with all its columns, in order of virtual finish time.

    Adds mix_pass (from 0) and mix_time. Rows are found again by all they hold and a number
    among equal ones, so null and repeated keys are taken as often as ``queue`` says.
    """
    # The text apart, as the digest of a long one is the only part that must not collide by chance.
    others = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns if c != text]
    ident = [F.md5(F.concat_ws("\1", *others).cast("binary")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))]
    names = ["ident_0", "ident_1"]
    number = F.row_number().over(W.partitionBy(*names).orderBy("until"))
    queued = materialize(queue(docs, weights, max_passes, key, text, source, ident).withColumn("ident_n", number), "queue")
    rows = docs.select(F.struct("*").alias("doc"), *[c.alias(n) for c, n in zip(ident, names, strict=True)])
    if queued.where("ident_n > 1").isEmpty():
        queued = queued.drop("ident_n")
    else:
        # Equal rows stand in any order: they are the same.
        rows = rows.withColumn("ident_n", F.row_number().over(W.partitionBy(*names).orderBy(F.lit(0))))
        names = [*names, "ident_n"]
    chosen = queued.where(F.col("copies") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    time = (F.col("until") + F.col("pass") * F.col("source_size")) / F.col("weight")
    added = {c: free_name(c, docs.columns) for c in ("mix_pass", "mix_time")}
    found = rows.join(chosen.select(*names, "pass", time.alias("time")), names).orderBy("time", f"doc.{key}", "pass")
    return found.select("doc.*", F.col("pass").alias(added["mix_pass"]), F.col("time").alias(added["mix_time"]))


def free_name(name: str, taken: Sequence[str]) -> str:
    lowered = {c.lower() for c in taken}
    while name in lowered:
        name += "_"
    return name


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return queue(docs).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, text, '')) AS h
  FROM documents),
sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM rows GROUP BY skey),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS most FROM sizes),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY most / w, skey) AS rank,
    sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY most / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM weighed),
marked AS (SELECT *, most * open_w <= w * rest AS is_full FROM ranked),
level AS (SELECT rest, open_w FROM marked WHERE NOT is_full ORDER BY rank LIMIT 1),
targets AS (
  SELECT skey, source_size, w,
    CASE WHEN is_full THEN most::DOUBLE ELSE (w * (SELECT rest FROM level))::DOUBLE / (SELECT open_w FROM level)::DOUBLE END AS target
  FROM marked),
timed AS (
  SELECT row_number() OVER () AS row, doc_id, skey, size, source_size, w, target,
    sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS until
  FROM rows JOIN targets USING (skey)),
instances AS (
  SELECT row, skey, size, until + p * source_size AS until, (until + p * source_size)::DOUBLE / w::DOUBLE AS finish
  FROM timed, (VALUES (0), (1), (2)) passes(p) WHERE size > 0),
queue AS (SELECT row, size, sum(size) OVER (ORDER BY finish, skey, until ROWS UNBOUNDED PRECEDING) AS running FROM instances),
chosen AS (SELECT row, sum(size)::BIGINT AS taken FROM queue WHERE running <= (SELECT sum(source_size) FROM sizes) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM timed LEFT JOIN chosen USING (row)
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE = {"op6_mixing": OP6_SQL}
