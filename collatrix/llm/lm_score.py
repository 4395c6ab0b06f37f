"""LM scoring by cross-entropy difference of two matched n-gram models.

Tokens are words. The target model is counted over the documents labelled good, the
background model over all documents, both over one vocabulary (words as hashes, out of ``VOCABULARY`` alike)
and with the same smoothing: a word's share of all words is mixed with ``UNIFORM`` of a law of its last ``ENDING`` bytes,
whose share is mixed with as much of a uniform law, and
its share of what follows the word before it, if that is known, counts ``PAIR``. So what neither model knows
costs the same in both, though one has counted more. A document is scored by counts of all other documents: its own
are taken out of both models, so no target document is scored by itself, and a text that occurs
twice is known to the background. A token's score is the background's loss less the
target's, a document's the mean: above 0, it is more like the target than like the corpus.

Scale. What is gathered grows with the corpus, so nothing of it is broadcast or collected.
Texts are dealt to chunks of ``CHUNK`` bytes by a hash; a chunk sends its distinct words and pairs
with counts to parts by their hash, packed to some eight bytes each, so a frequent pair is one entry per chunk; parts add up
the chunks and send back what others have; the chunk, whose texts are still in the same shuffle, scores its
documents. Keys are compared by 56 bits and the part's. Rows that repeat are combined before. Labels are broadcast only up to ``BROADCAST_LABELS`` rows.

Defined cases: words are runs of non-space with A-Z lower-cased; a null text or one without words has no tokens, and null losses and score; null
ids are not in the target; of labels that disagree about an id the lowest counts;
without target documents the target model is uniform; rows that repeat count and are scored
each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.near_duplicates import scramble, text_hash
from collatrix.llm.store import count_words, documents, read, small_batches

VOCABULARY = 1 << 36
#: Weights of the shorter law among words and endings, and of pairs.
UNIFORM, PAIR = 0.05, 0.5
#: Bytes of an ending, and the words that one stands for.
ENDING, ALIKE = 3, 1 << 12
ENDINGS = VOCABULARY // ALIKE
CHUNK = 8 << 20
PART = 8 << 20
BROADCAST_LABELS = 2_000_000

_U = np.uint64
_START = _U(0x51ED270B9E3779B9)
DEALT = "part int, chunk long, keys binary, background binary, target binary"
SCORED = "n_tokens long, loss_target double, loss_background double"
TOKENS = "token_losses array<struct<target: double, background: double>>"


class Numbers(dict):
    """Numbers things from 0 in the order in which they come."""

    def __missing__(self, x):
        n = self[x] = len(self)
        return n


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each value, first position and size of each group) of whole numbers from 0."""
    n = len(values)
    if not n:
        return values, values, values
    bits = n.bit_length()
    if int(values.max()).bit_length() + bits <= 63:  # values and places as one number: sorting is much faster than argsort
        packed = np.sort((values << bits) | np.arange(n))
        order, ranked = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    at = np.flatnonzero(new)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[at], np.diff(np.r_[at, n])


class Grams:
    """Words, their endings and pairs of a chunk's texts, as places among their keys. Texts in the same order give the same places."""

    def __init__(self, texts: list[str | None]):
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        self.n = np.array([len(w) for w in split], dtype=np.int64)
        total, numbers, ending_numbers = int(self.n.sum()), Numbers(), Numbers()
        self.word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=total)
        del split
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers] + [_START], dtype=_U)
        ending = np.array([ending_numbers[w[-ENDING:]] for w in numbers], dtype=np.int64)
        v = len(numbers)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.before = np.r_[v, self.word[:-1]][:total]
        self.before[(np.cumsum(self.n) - self.n)[self.n > 0]] = v
        pair, first, _ = grouped(self.before * (v + 1) + self.word)
        pair_keys = scramble(scramble(hashes[self.before[first]]) + hashes[self.word[first]] * _U(0x9E3779B97F4A7C15))
        names = np.array([int.from_bytes(e, "big") + (len(e) << 40) for e in ending_numbers], dtype=_U)
        # Keys of the words, the start, the endings and the pairs; the least bits tell kinds apart.
        kinds = (scramble(hashes), 1), (scramble(names), 3), (pair_keys, 0)
        self.keys = np.concatenate([(k & _U(0xFFFFFFFFFFFFFFFC)) | _U(kind) for k, kind in kinds])
        self.start, self.ending, self.pair = v, v + 1 + ending[self.word], v + 1 + len(names) + pair

    def own(self, which: np.ndarray) -> np.ndarray:
        """How often each position's key is in its own text."""
        group, _, n = grouped(self.doc * len(self.keys) + which)
        return n[group]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often each key occurs, a text counting ``weight`` times; the start occurs once a text that has words."""
        each = weight[self.doc].astype(np.float64)
        out = sum(np.bincount(x, each, len(self.keys)) for x in (self.word, self.pair, self.ending))
        out[self.start] += weight[self.n > 0].sum()
        return out.astype(np.int64)

    def own_counts(self) -> list[np.ndarray]:
        """Each position's word, pair and ending counts in its own text."""
        return [self.own(x) for x in (self.word, self.pair, self.ending)] if len(self.doc) else [self.word] * 3

    def losses(self, counts: np.ndarray, total: int, own: list[np.ndarray], mine: np.ndarray) -> np.ndarray:
        """Bits of each token by counts of the whole corpus, without its text's own ones where ``mine``."""
        if not len(self.doc):
            return np.zeros(0)
        out_of = mine[self.doc].astype(np.int64)
        n_word, n_pair, n_ending = (counts[x] - n * out_of for x, n in zip((self.word, self.pair, self.ending), own, strict=True))
        # The word before is that of the position before, or the start, which a text has once.
        own_before = np.where(self.before == self.start, 1, np.r_[0, own[0][:-1]]) * out_of
        n_before = counts[self.before] - own_before
        others = total - self.n[self.doc] * out_of
        known = lambda n, law: np.where(others > 0, (1 - UNIFORM) * n / np.maximum(others, 1) + UNIFORM * law, law)
        share = known(n_word, known(n_ending, 1 / ENDINGS) / ALIKE)
        return -np.log2(np.where(n_before > 0, PAIR * n_pair / np.maximum(n_before, 1) + (1 - PAIR) * share, share))


def pack(n: np.ndarray) -> bytes:
    """Counts as a byte each, those from 255 up as eight more at the end."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<i8", offset=n)
    return out


KEY_BYTES = 7


def pack_keys(keys: np.ndarray) -> bytes:
    """The lower seven bytes of keys; most of the upper one is in the part."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY_BYTES, 8), dtype=np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return wide.reshape(-1).view("<u8")


def dealt_keys(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of keys by part, the parts that have any, where each ends)."""
    part = ((keys >> _U(32)) % _U(parts)).astype(np.int64)
    bits = len(keys).bit_length()
    packed = np.sort((part << bits) | np.arange(len(keys)))
    order, ranked = packed & ((1 << bits) - 1), packed >> bits
    ends = np.flatnonzero(np.r_[ranked[1:] != ranked[:-1], True]) + 1
    return order, ranked[ends - 1], ends


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows such that its texts always come in the same order."""
    texts = pdf["text"].fillna("")
    return pdf.assign(text=texts).sort_values(["text_hash", "text"], kind="stable", ignore_index=True)


def count_chunk(parts: int):
    """A chunk's distinct keys with counts, a row for each part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        grams = Grams(list(pdf["text"]))
        copies = pdf["copies"].to_numpy(dtype=np.int64)
        counts = [grams.counts(copies), grams.counts(copies * pdf["is_target"].to_numpy(dtype=bool))]
        order, named, ends = dealt_keys(grams.keys, parts)
        chunk, rows = int(pdf["chunk"].iloc[0]), []
        for p, a, z in zip(named.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            own = order[a:z]
            rows.append((p, chunk, pack_keys(grams.keys[own]), *(pack(x[own]) for x in counts)))
        return pd.DataFrame(rows, columns=["part", "chunk", "keys", "background", "target"])

    return run


def add_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a part, what all other chunks count for its keys."""
    sizes = [len(x) // KEY_BYTES for x in pdf["keys"]]
    _, at = np.unique(np.concatenate([unpack_keys(x) for x in pdf["keys"]]), return_inverse=True)
    out = {"part": pdf["part"], "chunk": pdf["chunk"], "keys": None}
    for c in ("background", "target"):
        own = np.concatenate([unpack(x, n) for x, n in zip(pdf[c], sizes, strict=True)])
        more = np.bincount(at, own).astype(np.int64)[at] - own
        out[c] = [pack(x) for x in np.split(more, np.cumsum(sizes)[:-1])]
    return pd.DataFrame(out)


def score_chunk(parts: int, totals: tuple[int, int], with_tokens: bool):
    """Scores of a chunk's documents by their own counts and the others' that came back."""

    def run(pdf: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=columns).astype({"copies": "int64"})
        pdf = in_order(pdf)
        grams = Grams(list(pdf["text"]))
        copies, is_target = pdf["copies"].to_numpy(dtype=np.int64), pdf["is_target"].to_numpy(dtype=bool)
        order, _, ends = dealt_keys(grams.keys, parts)
        sizes = np.diff(np.r_[0, ends]).tolist()
        sums = sums.sort_values("part")
        own, out, each = grams.own_counts(), pdf[["key", "copies"]].assign(n_tokens=grams.n), {}
        for name, mine, total in (("background", np.ones(len(pdf), dtype=bool), totals[0]), ("target", is_target, totals[1])):
            counts = grams.counts(copies * mine)
            counts[order] += np.concatenate([unpack(x, n) for x, n in zip(sums[name], sizes, strict=True)])
            each[name] = grams.losses(counts, total, own, mine)
            mean = np.bincount(grams.doc, each[name], len(pdf)) / np.maximum(grams.n, 1)
            out[f"loss_{name}"] = np.where(grams.n > 0, mean, np.nan)
        if with_tokens:
            cuts = np.cumsum(grams.n)[:-1]
            pairs = zip(*(np.split(each[c], cuts) for c in ("target", "background")), strict=True)
            out["token_losses"] = [[{"target": a, "background": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in pairs]
        return out[columns]

    columns = ["key", "copies", "n_tokens", "loss_target", "loss_background"] + ["token_losses"] * with_tokens
    return run


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", with_tokens: bool = False) -> DataFrame:
    """Per row its key, n_tokens, loss_target, loss_background (bits per token) and score, their difference.

    ``target`` has the keys of the target documents, each once. ``with_tokens`` adds the losses of every token.
    """
    small_batches(docs.sparkSession)
    ids = target.select(F.col(key).alias("target_key"), F.lit(True).alias("in_target"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), text_hash(text).alias("text_hash"))
    names = rows.groupBy("key", "text_hash").agg(F.count("*").alias("copies"))
    if names.where("copies > 1").isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("key", "text_hash").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    marked = rows.join(ids, rows["key"] == ids["target_key"], "left").withColumn("is_target", F.coalesce("in_target", F.lit(False)))
    words = count_words(F.col("text")) * F.col("copies")
    sums = marked.agg(F.sum(words).alias("background"), F.sum(F.when(F.col("is_target"), words)).alias("target"), F.sum(F.octet_length("text")).alias("size")).first()
    size = sums["size"] or 0
    chunks, parts = max(1, math.ceil(size / CHUNK)), max(1, math.ceil(size / max(PART, math.sqrt(size * 512.0))))
    chunk = F.pmod(F.xxhash64("key", "text_hash"), F.lit(chunks))
    dealt = marked.select("key", "text_hash", "text", "copies", "is_target", chunk.alias("chunk")).groupBy("chunk")
    added = dealt.applyInPandas(count_chunk(parts), DEALT).groupBy("part").applyInPandas(add_part, DEALT)
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, copies long, {SCORED}" + (f", {TOKENS}" if with_tokens else "")
    scored = dealt.cogroup(added.groupBy("chunk")).applyInPandas(score_chunk(parts, (sums["background"] or 0, sums["target"] or 0), with_tokens), schema)
    known = [F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("loss_target", "loss_background")]
    each = scored.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    each = each.select(F.col("key").alias(key), "n_tokens", *known, *(["token_losses"] if with_tokens else []))
    return each.withColumn("score", F.col("loss_background") - F.col("loss_target"))


def good_documents(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys that every label calls good."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(key).agg(F.min(label).alias("label")).where("label > 0").select(key)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, good_documents(read(spark, sf_dir, "labels")))


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLE: dict[str, str] = {}
