"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words, words 64-bit hashes, and every run of ``GRAM`` words a gram hash.
Of the grams in each window of ``WINDOW`` words the least is kept. A span of
``WINDOW`` words that a document shares with an item keeps the same gram in
both, so joining the kept grams finds every shared span. Each hit is extended to
both sides, word by word, up to a window's length: if ``WINDOW`` words are equal
around it, they are hit. An item of fewer words is one gram of its own length.

Words are compared by their hashes: two different spans would need ten equal
64-bit hashes in a row to be taken for one.

Scale: a fixed bitmap over the kept grams of the benchmark (``BITMAP_MOST`` slots at
most) drops nearly all grams of a document inside its row, so little is joined.
The benchmark's side is broadcast only if it has ``BROADCAST_ROWS`` rows at most;
otherwise the join is shuffled, and adaptive execution splits hot grams. Hits
are one row per kept gram, not per window, and item lists are made once per
distinct set of hits, so a passage that is in a third of the documents and of
the items makes no pairs.

Defined cases: null texts have no words; items without words match nothing; null
item ids hit but are not listed; repeated item rows count once, repeated document
rows give a row each; empty tables give an empty result or no hits; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.store import documents, materialize, read

WINDOW = 10
GRAM = 5
BITMAP_LEAST, BITMAP_MOST = 1 << 16, 1 << 20
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIDE = WINDOW - GRAM


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, with A-Z lower-cased."""
    body = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(lowered, NOT_WORD), ""), lambda w: F.xxhash64(w))


def grams(h: Column, n: int) -> Column:
    """A hash of each run of ``n`` words."""
    first = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)], F.lit(n)))


def is_kept(g: Column, p: Column) -> Column:
    """Whether the gram at a place is the least of a window that it is in.

    So it is if the run of grams around it that are no less is as long as a window.
    """
    own, per = F.get(g, p), WINDOW - GRAM + 1

    def run(sign: int) -> Column:
        case = F.when(F.lit(False), F.lit(0))
        for j in range(1, per):
            case = case.when(~F.coalesce(F.get(g, p + sign * j) >= own, F.lit(False)), F.lit(j - 1))
        return case.otherwise(F.lit(per - 1))

    return run(-1) + run(1) >= per - 1


def around(h: Column, g: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """(kind, gram, at, left, right) of the kept grams, only wanted ones if told; left has the nearest word first.

    Each place is looked at once, so the work is in proportion to the text.
    """
    kept = lambda p: is_kept(g, p) if wanted is None else wanted(F.get(g, p)) & is_kept(g, p)
    places = F.filter(F.sequence(F.lit(0), F.size(g) - 1), kept)

    def place(p: Column) -> Column:
        left = F.slice(h, F.greatest(p - SIDE, F.lit(0)) + 1, F.least(p, F.lit(SIDE)))
        return F.struct(
            F.lit(0).alias("kind"),
            F.get(g, p).alias("gram"),
            p.alias("at"),
            F.reverse(left).alias("left"),
            F.slice(h, p + GRAM + 1, F.lit(SIDE)).alias("right"),
        )

    return F.transform(places, place)


def short_places(h: Column, n: int, wanted: Callable[[Column], Column]) -> Column:
    """What ``around`` returns, for items of ``n`` words, all of which are the gram."""
    none = F.array().cast("array<bigint>")

    def found(g: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: wanted(F.get(g, i)))
        spots = F.transform(at, lambda p: F.struct(F.lit(n).alias("kind"), F.get(g, p).alias("gram"), p.alias("at"), none.alias("left"), none.alias("right")))
        return F.when(F.size(g) > 0, spots).otherwise(F.filter(F.array(no_place()), lambda _: F.lit(False)))

    return let(grams(h, n), found)


def no_place() -> Column:
    none = F.array().cast("array<bigint>")
    return F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("gram"), F.lit(0).alias("at"), none.alias("left"), none.alias("right"))


def benchmark_places(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, kind, gram, left, right) of every kept gram of the items."""

    def of(h: Column) -> Column:
        case = F.when(F.size(h) >= WINDOW, let(grams(h, GRAM), lambda g: around(h, g)))
        for n in range(1, WINDOW):
            case = case.when(F.size(h) == n, short_places(h, n, lambda _: F.lit(True)))
        return case

    rows = items.select(F.col(key).cast("string").alias("item"), F.explode(let(word_hashes(F.col(text)), of)).alias("x"))
    return rows.select("item", "x.kind", "x.gram", "x.left", "x.right").distinct()


def bitmap(places: DataFrame) -> bytes:
    """One byte per slot of the grams: a fixed size, whatever the benchmark's."""
    n = places.select("gram").distinct().count()
    slots = BITMAP_LEAST
    while slots < BITMAP_MOST and slots < 32 * n:
        slots *= 2
    bits = bytearray(slots)
    for r in places.select(F.expr(f"gram & {slots - 1}L").alias("slot")).distinct().collect():
        bits[r["slot"]] = 1
    return bytes(bits)


def equal_words(a: Column, b: Column) -> Column:
    """Words that two sides have in common, from the nearest outwards."""
    case = F.when(F.lit(False), F.lit(0))
    for j in range(SIDE):
        case = case.when(~F.coalesce(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), F.lit(False)), F.lit(j))
    return case.otherwise(F.lit(SIDE))


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, end)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["until"]), F.lit(0))).alias("n"),
        F.greatest(a["until"], x["e"]).alias("until"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row its key, n_words, n_hit, n_items, items (sorted ids) and spans (word start, end)."""
    bench = materialize(benchmark_places(items, item_key, item_text), "benchmark")
    kinds = [r["kind"] for r in bench.select("kind").distinct().orderBy("kind").collect()]
    bits = bitmap(bench)
    slots = len(bits)
    maybe = lambda x: F.substring(F.lit(bits), x.bitwiseAND(F.lit(slots - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    none = F.filter(F.array(no_place()), lambda _: F.lit(False))

    def places(h: Column) -> Column:
        found = []
        for kind in kinds:
            if kind == 0:
                found.append(F.when(F.size(h) >= WINDOW, let(grams(h, GRAM), lambda g: around(h, g, maybe))).otherwise(none))
            else:
                found.append(short_places(h, kind, maybe))
        return F.struct(F.size(h).cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("places"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), let(word_hashes(F.col(text)), places).alias("x"))
    rows = rows.select("row", "key", "x.n_words", F.explode_outer("x.places").alias("p"))
    contexts = bench.select("kind", "gram", "left", "right").distinct().withColumn("context", context_id())
    n = bench.count()
    side = contexts.select("kind", "gram", F.col("left").alias("b_left"), F.col("right").alias("b_right"), "context")
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    # Rows without a place get keys that nothing has: as nulls they would meet in one task.
    rows = rows.withColumns({"p_kind": F.coalesce("p.kind", F.lit(-1)), "p_gram": F.coalesce("p.gram", F.xxhash64("row"))})
    joined = rows.join(side, (rows["p_kind"] == side["kind"]) & (rows["p_gram"] == side["gram"]), "left")
    before, after = equal_words(F.col("p.left"), F.col("b_left")), equal_words(F.col("p.right"), F.col("b_right"))
    joined = joined.withColumn("before", F.when(F.col("kind") == 0, before).otherwise(0)).withColumn("after", F.when(F.col("kind") == 0, after).otherwise(0))
    length = F.when(F.col("kind") == 0, F.col("before") + GRAM + F.col("after")).otherwise(F.col("kind"))
    is_hit = F.col("context").isNotNull() & ((F.col("kind") > 0) | (length >= WINDOW))
    start = F.col("p.at") - F.col("before")
    hits = joined.select(
        "row",
        "key",
        "n_words",
        F.when(is_hit, F.struct(start.alias("s"), (start + length).alias("e"))).alias("span"),
        F.when(is_hit, F.col("context")).alias("context"),
    )
    by_doc = hits.groupBy("row", "key", "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("context")).alias("contexts"))
    by_doc = by_doc.withColumn("hit_set", F.when(F.size("contexts") > 0, F.md5(F.concat_ws(",", F.col("contexts").cast("array<string>")).cast("binary"))))
    # A row per document, written: both uses below would read all texts anew.
    by_doc = materialize(by_doc, "hits")
    sets = by_doc.where(F.col("hit_set").isNotNull()).groupBy("hit_set").agg(F.first("contexts").alias("contexts"))
    listed = bench.select("item", context_id().alias("context")).distinct()
    lists = sets.select("hit_set", F.explode("contexts").alias("context")).join(listed, "context").groupBy("hit_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Documents without hits get a key each that nothing has: as nulls they would meet in one task.
    spread = F.coalesce("hit_set", F.concat(F.lit("none "), F.col("row").cast("string")))
    out = by_doc.withColumn("hit_set", spread).join(lists, "hit_set", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with an item."""
    named = docs.select(F.struct("*").alias("doc"), F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash")).alias("ident"), F.col(text).alias("text"))
    hit = materialize(decontaminate(named, items, "ident").where("n_hit > 0").select(F.col("ident").alias("one")), "contaminated")
    # Few hits are broadcast, which leaves the texts where they are; many are joined by a shuffle.
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return named.join(hit, named["ident"] == hit["one"], "left_anti").select("doc.*")


def context_id() -> Column:
    return F.xxhash64("kind", "gram", "left", "right")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens)),
hit AS (SELECT doc_id, dwin.n, i, item FROM dwin JOIN iwin ON dwin.n = iwin.n AND dwin.win = iwin.win),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE = {"op2_decontamination": OP2_SQL}
