"""Quality rules: an isolation forest on rule statistics.

Each document gets a row of rule statistics, one reading of its text. Base rules
reject short and repetitive texts outright. For the rest an isolation forest on
the statistics gives the mean path length over random splits: documents that
few splits isolate are anomalous. No statistic has a limit of its own. A split
picks a statistic in proportion to its range in the node, so that one which
sets a few rows far apart is split early. The cut-off comes from labelled rows.

The trees are grown from a bounded sample of labelled rows (``FIT_ROWS`` of them
by a hash of their id, the documented bound), each from ``TREE_ROWS`` of these,
of which ``BAD_SHARE`` are labelled bad: scarcer than the rare kinds of good rows
(lists, tables of numbers), or else these would be isolated first.
The cut-off is taken from the histogram of scores of all labelled rows, a
quarter up among those that reject at most ``GOOD_LOSS`` of the good and no fewer of the bad. Without
labels of both kinds, the base rules decide alone.

Defined cases: a null text has no words; a text without words fails the base
rules; rows that repeat are judged each; of labels that disagree about an id the
lowest counts, and null labels or ids are not learnt from; an empty table gives
an empty result; other columns are left out, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.store import documents, first_by_hash, materialize, read, release_memory, small_batches

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = b"!?"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FIT_ROWS = 8192
TREES = 64
TREE_ROWS = 2048
BAD_SHARE = 0.002
#: Levels of a tree beyond those of a balanced one.
DEEPER = 6
GOOD_LOSS = 0.005
BINS = 2000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "mean_word", "short_words"]
#: Ranges are compared as shares; lengths of words count in tens of characters.
SCHEMA = ", ".join([f"{x} long" for x in BASE] + [f"{x} double" for x in FEATURES])


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    n, until = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            n += i + 3 - max(i, until)
            until = i + 3
    return n


def statistics(text: str | None) -> tuple:
    """The base counts and the features of a text."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()
    n = len(words)
    chars = len(text or "") - (len(body) - len(body.translate(None, SPACE)))
    count = lambda kind: len(body) - len(body.translate(None, kind))
    symbols = count(SYMBOLS)
    lines = [x for x in body.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    upper, lower = count(UPPER), count(LOWER)
    per, each = max(chars, 1), max(n, 1)
    features = (
        symbols / per,
        dup / max(len(lines), 1),
        repeated / each,
        upper / max(upper + lower, 1),
        count(DIGITS) / per,
        count(MARKS) / per,
        min(chars / each, 50.0) / 10,
        sum(len(w) < 3 for w in words) / each,
    )
    return (n, chars, symbols, dup, repeated, *features)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``stats`` of the counts and features."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([statistics(x) for x in batch], columns=BASE + FEATURES)
        release_memory()

    return docs.withColumn("stats", of(F.col(text)))


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees of random splits as flat arrays; leaves point to themselves."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, bad_share: float = BAD_SHARE, seed: int = 17):
        rng = np.random.default_rng(seed)
        n_bad = min(len(bad), max(1, round(rows * bad_share))) if len(bad) else 0
        n_good = min(len(good), rows - n_bad)
        self.norm = max(mean_path(n_good + n_bad), 1e-9)
        self.depth = math.ceil(math.log2(max(n_good + n_bad, 2))) + DEEPER
        self.feature, self.cut, self.left, self.path, self.roots = [], [], [], [], []
        for _ in range(trees):
            picked = np.concatenate([good[rng.choice(len(good), n_good, replace=False)], bad[rng.choice(len(bad), n_bad, replace=False)] if n_bad else good[:0]])
            self.roots.append(self._grow(picked, 0, rng))
        self.feature, self.left, self.roots = (np.array(x, dtype=np.int32) for x in (self.feature, self.left, self.roots))
        self.cut, self.path = np.array(self.cut), np.array(self.path)

    def _node(self) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.cut.append(np.inf)
        self.left.append(at)
        self.path.append(0.0)
        return at

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        """Breadth first, so that a node's children stand side by side."""
        root = self._node()
        todo = [(root, rows, depth)]
        for at, own, d in todo:
            low, high = own.min(axis=0), own.max(axis=0)
            ranges = high - low
            if d >= self.depth or len(own) <= 1 or not ranges.any():
                self.path[at] = d + mean_path(len(own))
                continue
            f = int(rng.choice(len(ranges), p=ranges / ranges.sum()))
            cut = rng.uniform(low[f], high[f])
            side = own[:, f] > cut
            left, right = self._node(), self._node()
            self.feature[at], self.cut[at], self.left[at] = f, cut, left
            todo += [(left, own[~side], d + 1), (right, own[side], d + 1)]
        return root

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, from 0 to 1; 0.5 is a path of mean length."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = self.left[at]
            at = np.where(left == at, at, left + (x[row, self.feature[at]] > self.cut[at]))
        return 2.0 ** (-self.path[at].mean(axis=1) / self.norm)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` with a label each, the lowest of an id's; those without one are left out."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.min(label).alias("label"))
    return docs.join(one, docs[key] == one["label_key"]).drop("label_key")


def fit(measured: DataFrame, key: str = "key", fit_rows: int = FIT_ROWS) -> IsolationForest | None:
    """A forest from labelled rows (key, label, stats), ``fit_rows`` at most; None without rows labelled good."""
    halves = []
    for is_good, most in ((True, fit_rows - fit_rows // 8), (False, fit_rows // 8)):
        kept = first_by_hash(measured.where((F.col("label") > 0) if is_good else (F.col("label") <= 0)), key, most)
        rows = kept.select(*[f"stats.{x}" for x in FEATURES]).collect()
        halves.append(np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(FEATURES)))
    return IsolationForest(*halves) if len(halves[0]) else None


def with_score(measured: DataFrame, forest: IsolationForest) -> DataFrame:
    """``measured`` with the column ``anomaly``."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score(batch[FEATURES].to_numpy(dtype=float)))
        release_memory()

    return measured.withColumn("anomaly", score(F.col("stats")))


def threshold(scored: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """A cut-off that rejects at most ``good_loss`` of the rows labelled good, to a bin.

    Of the cut-offs that do, and that reject as many of those labelled bad as the lowest one
    of them (but for ``good_loss`` of these), one a quarter up from the lowest: clean rows that no
    labelled one is like have some room, and so have junk rows that are less anomalous than the labelled ones.
    """
    rows = scored.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad")).collect()
    counts = np.zeros((2, BINS + 1))
    for r in rows:
        counts[:, r["bin"]] = r["good"], r["bad"]
    good, bad = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    low = np.flatnonzero(good <= good_loss * good[0])
    if not len(low):
        return 1.0
    high = np.flatnonzero(bad >= (1 - good_loss) * bad[low[0]])[-1] if bad[low[0]] else low[0]
    return float(low[0] + (max(high, low[0]) - low[0]) / 4) / BINS


def base_failed() -> Column:
    """The base rules, on the column ``stats``."""
    return (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("stats.n_words"))


def calibrate(measured: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[IsolationForest | None, float]:
    """A forest of the labelled rows of ``measured`` (key, stats) that pass the base rules, and its cut-off."""
    named = labels.withColumnRenamed(key, "key") if key != "key" else labels
    known = labelled(measured.where(~base_failed()), named, "key")
    forest = fit(known)
    return (forest, threshold(with_score(known, forest))) if forest else (None, 1.0)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, the base counts, base_failed, anomaly (null where the base rules decide alone) and kept."""
    measured = materialize(measure(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text"), "quality")
    forest, cut = calibrate(measured, labels, key)
    scored = with_score(measured, forest) if forest else measured.withColumn("anomaly", F.lit(None).cast("double"))
    kept = ~base_failed() & (F.coalesce("anomaly", F.lit(0.0)) < cut)
    return scored.select(F.col("key").alias(key), *[F.col(f"stats.{x}").alias(x) for x in BASE], base_failed().alias("base_failed"), "anomaly", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps. Texts are measured twice, but never shuffled."""
    measured = materialize(measure(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text"), "quality")
    forest, cut = calibrate(measured, labels, key)
    rows = measure(docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))).where(~base_failed())
    rows = with_score(rows, forest).where(F.col("anomaly") < cut) if forest else rows
    return rows.select("doc.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE: dict[str, str] = {}
