"""Toxicity by multiple-instance learning: documents carry labels, sentences carry scores.

A sentence's score is a logistic of the weights of its words; a document's is
the noisy-or of its sentences', 1 - prod(1 - p). Both are trained together from
document labels, and the sentences that made a document's score are then located.
A word weighs what it and its prefixes weigh, so unseen compounds of a known
stem count.

The classifier is fitted on a bounded sample of labelled rows, ``FIT_ROWS`` per
class at most, by a hash of the id (the documented bound). All texts are scored whole.

Defined cases: a null or empty text has no sentence and scores 0; null ids are
not learnt from and not held out; of labels that disagree about an id the
highest counts; rows that repeat are scored each; without labels of both kinds
every score is 0; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.store import documents, first_by_hash, read, small_batches

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)
FIT_ROWS = 2500
MIN_DOCS = 4
#: Least z value of a feature's difference between the classes.
MIN_Z = 3.0
STEPS = 400
RATE = 0.05
RIDGE = 2e-5
CACHE_MOST = 500_000


def features_of(word: str) -> list[str]:
    """The word and its prefixes; a prefix ends in ``*``."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


@dataclass
class SentenceModel:
    """Weights of features and the bias of every sentence."""

    weights: dict[str, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        value = self.cache.get(word)
        if value is None:
            if len(self.cache) > CACHE_MOST:
                self.cache.clear()
            get = self.weights.get
            value = self.cache[word] = sum(get(f, 0.0) for f in features_of(word))
        return value

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence with a word."""
        out, weigh = [], self.word_weight
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m.group().lower()))
            if words:
                z = self.bias + sum(map(weigh, words))
                out.append((m.start(), m.end(), 1.0 / (1.0 + float(np.exp(-min(max(z, -30.0), 30.0))))))
        return out

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences' scores."""
        clean, bias, get, weigh = 0.0, self.bias, self.cache.get, self.word_weight
        base = float(np.logaddexp(0.0, bias))
        for sentence in SENTENCE.findall((text or "").lower()):
            words = set(WORD.findall(sentence))
            if words:
                gain = 0.0
                for w in words:
                    v = get(w)
                    gain += weigh(w) if v is None else v
                clean += base if gain == 0.0 else float(np.logaddexp(0.0, bias + gain))
        return 1.0 - float(np.exp(-clean))


def fit_sentences(texts: list[str], target: np.ndarray, weight: np.ndarray) -> SentenceModel | None:
    """Train on texts with labels 0 and 1, by full-batch descent from the features' log odds."""
    target = np.asarray(target, dtype=bool)
    if not target.any() or target.all():
        return None
    # Texts become arrays of word numbers, and words arrays of feature numbers, so that a large sample stays small.
    words: dict[str, int] = {}
    bags, sentence_doc, sizes = [], [], []
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text.lower()):
            if bag := set(WORD.findall(sentence)):
                bags.append(np.array([words.setdefault(w, len(words)) for w in bag], dtype=np.int32))
                sentence_doc.append(d)
                sizes.append(len(bag))
    found: dict[str, int] = {}
    of_word = [[found.setdefault(f, len(found)) for f in features_of(w)] for w in words]
    word_start = np.cumsum([0] + [len(x) for x in of_word])
    word_features = np.array([f for x in of_word for f in x], dtype=np.int32)
    del of_word
    flat = np.concatenate(bags) if bags else np.zeros(0, dtype=np.int32)
    sentence_doc, row = np.array(sentence_doc, dtype=np.int64), np.repeat(np.arange(len(bags)), sizes)
    seen = np.zeros((2, len(found)), dtype=np.int64)
    bounds = np.searchsorted(sentence_doc[row], np.arange(len(texts) + 1))
    for d, y in enumerate(target):
        own = np.unique(flat[bounds[d] : bounds[d + 1]])
        if len(own):
            held = np.unique(np.concatenate([word_features[word_start[w] : word_start[w + 1]] for w in own]))
            seen[int(y), held] += 1
    n1, n0 = int(target.sum()), int((~target).sum())
    a, b = seen[1], seen[0]
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = np.flatnonzero((a + b >= MIN_DOCS) & (np.abs(z) >= MIN_Z))
    w = 0.1 * np.log((a[chosen] + 0.5) / (n1 + 1) / ((b[chosen] + 0.5) / (n0 + 1)))
    spelled = list(found)
    names = [spelled[f] for f in chosen]
    del found, spelled
    number = np.full(len(a), -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    known = number[word_features]
    kept = np.flatnonzero(known >= 0)
    per_word = np.searchsorted(kept, word_start)
    n_of = np.diff(per_word)[flat]
    row = np.repeat(row, n_of)
    step_in = np.arange(len(row)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    col = known[kept][np.repeat(per_word[:-1][flat], n_of) + step_in]
    bias, n, params = -5.0, len(texts), None
    weight = np.asarray(weight, dtype=float) / np.sum(weight)
    m = v = np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(row, w[col], len(sentence_doc)), -30, 30)
        clean = np.bincount(sentence_doc, np.logaddexp(0.0, z), n)
        pull = np.where(target, -1.0 / np.expm1(np.maximum(clean, 1e-9)), 1.0) * weight
        dz = pull[sentence_doc] / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(col, dz[row], len(w)) + RIDGE * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = np.append(w, bias) - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = params[:-1], float(params[-1])
    return SentenceModel({f: float(x) for f, x in zip(names, w, strict=True)}, bias)


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> SentenceModel | None:
    """A model of labelled rows that are not held out."""
    named = labels.select(F.col(key).alias("label_key"), F.col(label).alias("label"))
    one = named.where(F.col("label_key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("label_key")))
    one = one.groupBy("label_key").agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in one.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    chosen = [first_by_hash(one.where((F.col("label") > 0) == bool(y)), "label_key", fit_rows) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), texts["key"] == picked["label_key"]).select("label", "text").collect()
    target = np.array([r["label"] > 0 for r in rows], dtype=bool)
    share = {y: totals.get(int(y), 0) / max(1, int((target == y).sum())) for y in (False, True)}
    return fit_sentences([r["text"] for r in rows], target, np.array([share[bool(y)] for y in target], dtype=float))


def score(docs: DataFrame, model: SentenceModel | None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(x) for x in batch], dtype=float)

    return docs.withColumn("score", of(F.col(text)))


SPANS = "array<struct<start: int, end: int, sentence: string, score: double>>"


def located(docs: DataFrame, model: SentenceModel | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with a column ``sentences``: the offending ones (start, end, sentence, score), of ``least`` or more, in order. A text can score 0.5 by many mild sentences, none of which is offending by itself."""
    if model is None:
        return docs.withColumn("sentences", F.array().cast(SPANS))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[(a, b, x[a:b], p) for a, b, p in shared.value.sentences(x) if p >= least] if x else [] for x in batch])

    return docs.withColumn("sentences", spans(F.col(text)))


def locate(docs: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The offending sentences: (key, start, end, sentence, score) of those that score ``least`` or more."""
    found = located(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, least=least)
    return found.select(F.col("key").alias(key), F.explode("sentences").alias("x")).select(key, "x.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    # Sentences are looked for in texts that are predicted toxic only: few, so the others are read once.
    predicted = (F.col("score") >= 0.5).cast("int")
    toxic = F.when(F.col("score") >= 0.5, F.col("text"))
    found = located(scored.select("doc_id", "score", predicted.alias("predicted"), toxic.alias("text")), model)
    offending = F.transform("sentences", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", offending.alias("sentences"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
