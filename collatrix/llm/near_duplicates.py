"""Near-duplicates by DartMinHash signatures, banded joining and an exact check.

A text is the weighted set of its 5-word shingles, a shingle weighing as often as
it occurs. Over every element stands a region, as wide as its weight and
unbounded in rank; hashed darts fall into its cells as a Poisson process that
depends on the element alone. Each dart names a coordinate, and each coordinate
keeps its earliest dart: two sets agree in a coordinate with the probability of
their weighted Jaccard similarity. Ranks are thrown in blocks that double, only
as far as needed to fill all coordinates, so the work hardly depends on weights.

Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates. At a similarity of
0.8 a pair misses all bands with a probability of 1.5e-5. Equal texts are one row
before that. Rows that share a band are linked to the band's first row, and the
components of these links are families. Signatures are compared first (pairs ``MARGIN`` under the
threshold are out, four standard errors), then shingles. The components of the links that are found are the classes.

All pairs of a family are compared while it has ``FAMILY_BLOCKS`` blocks of ``BLOCK_TEXTS`` at most. Of larger ones,
each text is compared with one head that shares a band with it, ``HEAD_ROUNDS`` times, which
unites most of a group of copies by one comparison per text and round. Then only
texts that share a band and are not united yet are compared: those outside a band's largest
united group with all others of the band (or of the family, where that is less to deal), in blocks, so that no pair that shares a band is left out.

Defined cases: words are runs of non-space with A-Z lower-cased; fewer than five
words are one shingle; null texts and texts without words are equal texts; of a
class, the row with the least id is kept (null ids last); repeated rows are
copies; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.store import documents, materialize, release_memory, released, small_batches
from collatrix.operators.graph import connected_components as components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 28
COORDINATES = ROWS * BANDS
#: Darts that fill all coordinates in most cases.
DARTS = COORDINATES * (math.log(COORDINATES) + 2.0)
FIRST_BLOCK = 2.0**-8
MARGIN = 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
#: Texts and shingles of one block, at most two of which meet in a task.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 200_000
#: Blocks of a family in which all pairs are compared, and rounds with heads for larger ones.
FAMILY_BLOCKS, HEAD_ROUNDS = 4, 2
#: A key is hot with so many rows, and with this share of all rows: so there are few, which can be broadcast.
HOT_ROWS, HOT_SHARE = 1000, 1e-4
CACHE_MOST = 100_000

_U = np.uint64
_WORDS: dict[bytes, int] = {}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def times(n: int, i: int) -> np.uint64:
    """A number times a multiplier, modulo 2 ** 64."""
    return _U(n * int(_MULTIPLIERS[i]) & 0xFFFFFFFFFFFFFFFF)


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_WORDS) > CACHE_MOST:
        _WORDS.clear()
    get, out = _WORDS.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=_U)


def shingles(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of word hashes, in order of the text."""
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, dtype=_U)
    for j in range(min(SHINGLE, len(h))):
        total += scramble(h[j : j + n] + _U(j)) * _MULTIPLIERS[j]
    return scramble(total + _U(min(SHINGLE, len(h))))


def unit_cells(s: np.ndarray) -> np.ndarray:
    """The unit cells under the weights: a shingle that occurs w times has the layers 0 to w - 1."""
    s = np.sort(s)
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(first)
    layer = np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)]))
    return scramble(s ^ scramble(layer.astype(_U) + _U(0x51ED270B)))


def poisson_table(mean: float) -> np.ndarray:
    """Distribution function of the Poisson law, as far as it is not 1."""
    p, total, out, k = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < mean + 40 * math.sqrt(mean) + 40:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def blocks(level: int) -> tuple[float, float]:
    """Least and greatest rank of a block."""
    return (0.0, FIRST_BLOCK) if level == 0 else (FIRST_BLOCK * 2 ** (level - 1), FIRST_BLOCK * 2**level)


def throw(cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of unit cells in a block of ranks: (index of the cell, coordinate, rank)."""
    low, high = blocks(level)
    base = scramble(cells + times(level + 1, 0))
    piece = min(high - low, 256.0)  # a wider block is thrown in pieces, whose law can be tabled
    table, found = poisson_table(piece), []
    for part in range(round((high - low) / piece)):
        own = scramble(base + times(part, 1))
        n = np.searchsorted(table, uniform(own), side="right")
        cell = np.repeat(np.arange(len(cells)), n)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        dart = scramble(own[cell] + (nth.astype(_U) + _U(1)) * _MULTIPLIERS[2])
        rank = low + piece * (part + uniform(dart))
        found.append((cell, (scramble(dart + _MULTIPLIERS[3]) % _U(COORDINATES)).astype(np.int64), rank))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The earliest dart's rank in each coordinate, a row per set of unit cells; empty sets have infinity."""
    k = COORDINATES
    out = np.full((len(sets), k), np.inf)
    sizes = np.array([len(x) for x in sets])
    todo = np.flatnonzero(sizes > 0)
    if not len(todo):
        return out
    need = np.zeros(len(sets), dtype=int)
    need[todo] = np.ceil(np.log2(np.maximum(DARTS / sizes[todo] / FIRST_BLOCK, 1.0))).astype(int)
    level = 0
    while len(todo):
        cells = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        cell, coordinate, rank = throw(cells, level)
        np.minimum.at(out.reshape(-1), owner[cell] * k + coordinate, rank)
        todo = todo[(need[todo] > level) | np.isinf(out[todo]).any(axis=1)]
        level += 1
    return out


def band_keys(ranks: np.ndarray) -> np.ndarray:
    """A key per band; equal coordinates give equal keys."""
    bits = ranks.view(_U).reshape(len(ranks), BANDS, ROWS)
    total = np.broadcast_to((np.arange(BANDS, dtype=_U) + _U(1)) * _MULTIPLIERS[4], (len(ranks), BANDS)).copy()
    for j in range(ROWS):
        total = scramble(total + scramble(bits[:, :, j]) * _MULTIPLIERS[j])
    return total.view(np.int64)


def short_signature(ranks: np.ndarray) -> np.ndarray:
    """32 bits of each coordinate, for comparing."""
    return (scramble(ranks.view(_U)) >> _U(32)).astype(np.uint32)


def sequence_id(h: np.ndarray) -> bytes:
    """128 bits that name a sequence of words."""
    return xxhash.xxh128_digest(h.tobytes())


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, text_hash, words_id, n, bands, sig) per document row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("words_id binary, n long, bands array<long>, sig binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashed = [word_hashes(x) for x in batch]
            sets = [unit_cells(shingles(h)) for h in hashed]
            ranks = signatures(sets)
            short = short_signature(ranks)
            keys = band_keys(ranks)
            yield pd.DataFrame(
                {
                    "words_id": [sequence_id(h) for h in hashed],
                    "n": np.array([len(x) for x in sets], dtype=np.int64),
                    "bands": list(keys),
                    "sig": [x.tobytes() for x in short],
                }
            )
        release_memory()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_hash(text).alias("text_hash"), of(F.col(text)).alias("x"))
    return rows.select("row", "key", "text_hash", "x.*")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Forest:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def is_similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets of unit cells are so similar."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_links(rows: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, group: np.ndarray | None = None, united: bool = False) -> list[tuple[int, int]]:
    """A forest of the links between texts, by signatures, then exactly.

    With ``group``, only texts of different groups are compared; if groups are ``united``, a link ties whole groups, and further ones between them are not looked for.
    """
    sizes = np.array([len(x) for x in sets], dtype=float)
    pairs = []
    for a in range(len(rows) - 1):
        fits = np.minimum(sizes[a + 1 :], sizes[a]) >= similarity * np.maximum(sizes[a + 1 :], sizes[a])
        if group is not None:
            fits &= group[a + 1 :] != group[a]
        b = np.flatnonzero(fits) + a + 1
        near = (sigs[b] == sigs[a]).mean(axis=1)
        fine = near >= similarity - MARGIN
        b, near = b[fine], near[fine]
        pairs.append(np.stack([np.full(len(b), a), b, -near * 1e6], axis=1))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3))
    pairs = pairs[np.argsort(pairs[:, 2], kind="stable")][:, :2].astype(int)
    forest, found = Forest(len(rows)), []
    if united:
        first: dict[int, int] = {}
        for k, g in enumerate(group.tolist()):
            forest.join(first.setdefault(g, k), k)
    for a, b in pairs.tolist():
        if forest.find(a) != forest.find(b) and is_similar(sets[a], sets[b], similarity):
            forest.join(a, b)
            found.append((int(rows[a]), int(rows[b])))
    return found


def family_links(united: bool):
    """Links of a task: families of a bin, or two blocks of a larger group.

    Rows of the same ``side`` are not compared where it is not null; if sides are ``united``, each is named by a row of it, and links are between these.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("family", sort=False):
            own = own.drop_duplicates("row").sort_values("row")
            sigs = np.frombuffer(b"".join(own["sig"]), dtype=np.uint32).reshape(len(own), COORDINATES)
            sets = [np.frombuffer(x, dtype=_U) for x in own["cells"]]
            side = None if own["side"].isna().any() else own["side"].to_numpy()
            found = similar_links(own["row"].to_numpy(), sigs, sets, group=side, united=united)
            if united:
                name = dict(zip(own["row"].tolist(), own["side"].tolist(), strict=True))
                found = [(name[a], name[b]) for a, b in found]
            out += found
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def with_cells(members: DataFrame, docs: DataFrame, key: str, text: str, repeated: bool) -> DataFrame:
    """``members`` (key, text_hash, words_id, ...) with their texts' unit cells; ``repeated`` tells that rows of ``docs`` repeat."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ids in batches:
            hashed = [word_hashes(x) for x in texts]
            yield pd.Series([np.sort(unit_cells(shingles(h))).tobytes() if sequence_id(h) == bytes(i) else None for h, i in zip(hashed, ids, strict=True)])
        release_memory()

    texts = docs.select(F.col(key).alias("text_key"), text_hash(text).alias("own_hash"), F.col(text).alias("text"))
    # By id and hash of the text, so that null ids, or an id with many texts, meet their own text only. Rows that repeat are combined before the shuffle.
    texts = texts.dropDuplicates(["text_key", "own_hash"]) if repeated else texts
    joined = members.join(texts, (members["text_hash"] == texts["own_hash"]) & members["key"].eqNullSafe(texts["text_key"])).drop("text_key", "own_hash")
    # It takes a column of either side, so that only the texts of members are hashed again.
    return joined.withColumn("cells", of(F.col("text"), F.col("words_id"))).drop("text").where("cells IS NOT NULL")


def star_links(banded: DataFrame) -> DataFrame:
    """Links (a, b) that hold together what shares a band, from (row, head).

    A row is linked to its least head only, and that to the row's other heads: a
    group of copies has few heads, so it makes about one link per row, not one per band.
    """
    heads = banded.groupBy("row").agg(F.min("head").alias("b"), F.collect_set("head").alias("heads"))
    links = heads.select(F.explode(F.array_append("heads", F.col("row"))).alias("a"), "b")
    return links.where("a <> b").distinct()


def blocks_of(rows: Column, shingle_count: Column) -> Column:
    return F.ceil(F.greatest(rows / BLOCK_TEXTS, shingle_count / BLOCK_SHINGLES)).cast("int")


def pairs_in_blocks(filled: DataFrame, n: int) -> DataFrame:
    """Links of families (family, row, parts, sig, cells) by all their pairs, in blocks if they have several parts. ``n`` rows are about so many."""
    none = F.lit(None).cast("long")
    blocked = filled.withColumn("block", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = blocked.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    large = F.col("parts") > 1
    bin_of = F.when(large, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(max(1, n // BLOCK_TEXTS))))
    side = F.when(F.col("i") == F.col("j"), none).otherwise(F.col("block").cast("long"))
    groups = meet.select("family", "row", "i", "j", "sig", "cells", side.alias("side"), large.alias("large"), bin_of.alias("bin"))
    return groups.groupBy("large", "bin", "i", "j").applyInPandas(released(family_links(False)), "a long, b long")


def is_hot(count: Column, n: int) -> Column:
    return count > max(HOT_ROWS, n * HOT_SHARE)


def join_spread(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """Inner join with ``right`` (key, n_rows, ...), whose keys are unique: hot keys, at most 1 / HOT_SHARE of them, are broadcast and leave the shuffle."""
    own = [c for c in right.columns if c not in (key, "n_rows")]
    sides = [right.where(c).select(F.col(key).alias(f"key_{i}"), F.struct(*own).alias(f"x_{i}")) for i, c in enumerate((is_hot(F.col("n_rows"), n), ~is_hot(F.col("n_rows"), n)))]
    out = left.join(F.broadcast(sides[0]), F.col(key) == F.col("key_0"), "left")
    # Rows that are served get a null key each with a number, which spreads them.
    spread = F.when(F.col("x_0").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(F.lit(None).cast(left.schema[key].dataType).alias("k"), F.xxhash64("row").alias("s")))
    other = sides[1].withColumn("spread_1", F.struct(F.col("key_1").alias("k"), F.lit(0).cast("long").alias("s")))
    out = out.withColumn("spread_0", spread).join(other, F.col("spread_0") == F.col("spread_1"), "left")
    return out.select(*[left[c] for c in left.columns], F.coalesce("x_0", "x_1").alias("x")).where("x IS NOT NULL").select(*left.columns, "x.*")


def united(banded: DataFrame, links: DataFrame | None) -> DataFrame:
    """``banded`` (row, band, family) with the row's group by the links found so far."""
    if links is None:
        return banded.withColumn("root", F.col("row"))
    labels = components(links)
    return banded.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def head_links(grouped: DataFrame, filled: DataFrame, seed: int, n: int) -> DataFrame:
    """Links of rows to a head each: of the heads that share a band with a row and are of another group, that of the least hash."""
    order = F.struct(F.xxhash64("row", F.lit(seed)).alias("h"), F.col("row").alias("head"), F.col("root").alias("head_root"))
    heads = grouped.groupBy("band").agg(F.min(order).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_rows")).where("lo <> hi")
    chosen = join_spread(grouped, heads.select("band", "x", "n_rows"), "band", n).where(F.col("root") != F.col("x.head_root")).groupBy("row").agg(F.min("x").alias("x")).select("row", "x.head")
    chosen = materialize(chosen, "heads")
    counted = chosen.groupBy("head").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / HOT_ROWS).cast("int"))
    # A head with many rows is salted: its cells go to several tasks.
    hot = F.broadcast(counted.where(is_hot(F.col("m"), n)).select(F.col("head").alias("hot_head"), "salts"))
    salted = chosen.join(hot, F.col("head") == F.col("hot_head"), "left").select("row", "head", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).alias("salt"))
    sides = counted.withColumn("salt", F.explode(F.when(is_hot(F.col("m"), n), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(0)))))
    sides = sides.join(filled.select(F.col("row").alias("head"), F.col("sig").alias("head_sig"), F.col("cells").alias("head_cells")), "head").drop("m", "salts")

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        view = lambda x, kind: np.frombuffer(x, dtype=kind)
        for s, c, hs, hc in batches:
            yield pd.Series([bool((view(a, np.uint32) == view(p, np.uint32)).mean() >= SIMILARITY - MARGIN and is_similar(view(b, _U), view(q, _U))) for a, b, p, q in zip(s, c, hs, hc, strict=True)])

    pairs = salted.join(filled.select("row", "sig", "cells"), "row").join(sides, ["head", "salt"])
    return pairs.where(similar("sig", "cells", "head_sig", "head_cells")).select(F.col("row").alias("a"), F.col("head").alias("b"))


def deal(sizes: DataFrame) -> DataFrame:
    """(unit, main, few, many, small, cost, n_rows) of units (unit, root, k): their largest group, blocks outside and inside it, and how many rows are dealt."""
    own = sizes.groupBy("unit").agg(F.max(F.struct("k", "root")).alias("x"), F.sum("k").alias("n_rows"))
    rest = F.col("n_rows") - F.col("x.k")
    blocks = own.select("unit", F.col("x.root").alias("main"), F.ceil(rest / BLOCK_TEXTS).cast("int").alias("few"), F.ceil(F.col("x.k") / BLOCK_TEXTS).cast("int").alias("many"), "n_rows", F.col("x.k").alias("k"), rest.alias("rest"))
    cost = F.when(F.col("n_rows") <= BLOCK_TEXTS, F.col("n_rows")).otherwise(F.col("k") * F.col("few") + F.col("rest") * (F.col("few") + F.col("many")))
    return blocks.select("unit", "main", "few", "many", (F.col("n_rows") <= BLOCK_TEXTS).alias("small"), cost.alias("cost"), "n_rows")


def rest_links(grouped: DataFrame, filled: DataFrame, n: int) -> DataFrame:
    """Links between texts that share a band and are of different groups: rows outside the largest group of a unit against all its rows, in blocks.

    A unit is a band, or a family where that deals fewer rows: in a group of copies most bands have the same rows.
    """
    # Bands of the same rows are one.
    marks = grouped.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n_rows"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("x")).where("lo <> hi")
    kept = marks.groupBy("n_rows", "x").agg(F.min("band").alias("band")).select("band", F.lit(1).alias("one"), "n_rows")
    rows = materialize(join_spread(grouped, kept, "band", n).drop("one"), "open_bands")
    by_band = materialize(deal(rows.groupBy(F.col("band").alias("unit"), "root").agg(F.count("*").alias("k"))), "bands")
    whole = rows.groupBy("family", "row", "root").agg(F.count("*").alias("bands")).drop("bands")
    by_family = materialize(deal(whole.groupBy(F.col("family").alias("unit"), "root").agg(F.count("*").alias("k"))), "open_families")
    family_of = rows.groupBy("band").agg(F.first("family").alias("family")).join(by_band.select(F.col("unit").alias("band"), "cost"), "band")
    costs = family_of.groupBy("family").agg(F.sum("cost").alias("in_bands")).join(by_family.select(F.col("unit").alias("family"), "cost", "n_rows"), "family")
    costs = costs.select("family", (F.col("cost") <= F.col("in_bands")).alias("as_one"), "n_rows")
    # The rows of a family are as many in ``rows`` as its bands say.
    as_one = join_spread(rows, costs, "family", n)
    left = as_one.where(~F.col("as_one")).select(F.lit(0).alias("kind"), F.col("band").alias("unit"), "row", "root")
    left = left.unionByName(as_one.where("as_one").select(F.lit(1).alias("kind"), F.col("family").alias("unit"), "row", "root").distinct())
    sizes = by_band.withColumn("kind", F.lit(0)).unionByName(by_family.withColumn("kind", F.lit(1)))
    named = lambda df: df.withColumn("unit", F.struct("kind", "unit")).drop("kind")
    dealt = join_spread(named(left), named(sizes), "unit", n).withColumn("is_main", F.col("root") == F.col("main"))
    block = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    spots = lambda c, pair: F.transform(F.sequence(F.lit(0), F.col(c) - 1), pair)
    spot = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    # Blocks of the few are named from 0 up, those of the largest group from -1 down.
    own = block("few")
    few = F.array_distinct(F.concat(spots("few", lambda o: spot(F.least(own, o), F.greatest(own, o))), spots("many", lambda o: spot(-1 - o, own))))
    many = spots("few", lambda o: spot(-1 - block("many"), o))
    where = F.when(F.col("small"), F.array(spot(F.lit(0), F.lit(0)))).when(F.col("is_main"), many).otherwise(few)
    bins = F.pmod(F.xxhash64("unit"), F.lit(max(1, n // BLOCK_TEXTS)))
    name = F.xxhash64("unit")
    meet = dealt.select(name.alias("family"), "row", F.col("root").alias("side"), F.when(F.col("small"), bins).otherwise(name).alias("bin"), (~F.col("small")).alias("large"), F.explode(where).alias("x"))
    groups = meet.join(filled.select("row", "sig", "cells"), "row").select("family", "row", "side", "bin", "large", "x.i", "x.j", "sig", "cells")
    return groups.groupBy("large", "bin", "i", "j").applyInPandas(released(family_links(True)), "a long, b long").distinct()


def links_of_large(filled: DataFrame, banded: DataFrame) -> DataFrame:
    """Links inside families that are too large for all their pairs, from their rows (row, family, sig, cells) and (row, band)."""
    filled = materialize(filled.select("row", "family", "sig", "cells"), "large")
    banded = materialize(banded.join(filled.select("row", "family"), "row"), "large_bands")
    n, links = filled.count(), None
    for seed in range(HEAD_ROUNDS):
        found = head_links(united(banded, links), filled, seed, n)
        links = materialize(found if links is None else links.unionByName(found), "head_links")
    rest = rest_links(united(banded, links), filled, n)
    return rest if links is None else links.unionByName(rest)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, class_id (the least key of its class), class_size and kept (one row of a class)."""
    signed = materialize(sign(docs, key, text), "signatures")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), F.col("key"), F.col("row")))
    texts = signed.groupBy("words_id").agg(F.min("row").alias("rep"), first.alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))
    texts = materialize(texts, "texts")
    reps = signed.join(texts.where("n > 0").select(F.col("rep").alias("row")), "row", "left_semi")
    banded = reps.select("row", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    families = components(star_links(banded.join(heads, "band"))).withColumnRenamed("root", "family")
    members = families.withColumnRenamed("node", "row").join(signed.select("row", "key", "text_hash", "words_id", "n", "sig"), "row")
    size = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    size = materialize(size.select("family", "m", blocks_of(F.col("m"), F.col("total")).alias("parts")), "families")
    repeated = not signed.groupBy("key", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    # A family larger than the blocks allow has so many rows that there are few of it.
    large = F.col("parts") > FAMILY_BLOCKS
    has_large = not size.where(large).isEmpty()
    sized = members.join(size.select("family", "parts"), "family")
    n = size.agg(F.sum("m")).first()[0] or 0
    fill = lambda rows: with_cells(rows, docs, key, text, repeated)
    links = pairs_in_blocks(fill(sized.where(~large)), n)
    if has_large:
        links = links.unionByName(links_of_large(fill(sized.where(large)), banded))
    joined = components(links)
    n_texts = texts.count()
    rooted = texts.withColumnRenamed("rep", "row").join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"), F.count("*").alias("n_rows"))
    named = join_spread(rooted.select("row", "words_id", "root", "copies"), chosen, "root", n_texts)
    named = named.select("words_id", "best", "class_size", F.col("copies").alias("n_rows"))
    out = join_spread(signed.select("row", "key", "words_id"), named, "words_id", n_texts)
    return out.select(F.col("key").alias(key), F.col("best.key").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each class: that with the least key."""
    named = docs.select(F.struct("*").alias("doc"), F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash")).alias("ident"), F.col(text).alias("text"))
    kept = classes(named, "ident", "text").where("kept").select(F.col("ident").alias("one"))
    rows = named.join(kept, named["ident"] == kept["one"], "left_semi")
    # Rows that repeat with id and text are one class, of which both would stay; where there are none, texts need not be shuffled for it.
    if named.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["ident"])
    return rows.select("doc.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
ORACLE: dict[str, str] = {}
