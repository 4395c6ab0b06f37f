import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.llm import quality
from collatrix.llm.store import documents, read
from tests.llm.brute import base_counts


def make(rng, n, words="ab cd efg hij klm no pq rst uv wxyz".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))


def test_counts_equal_plain_ones():
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a b c a b c", "x\nx\n x\n\nx", "é ü#|<> \u00a0z\x1cq", "a\r\na\r\n"]
    texts += ["".join(rng.choice("ab é#\n\t ") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for t in texts:
        assert quality.statistics(t)[:5] == base_counts(t), repr(t)


def fixture(spark):
    rng = random.Random(2)
    rows = [(i, make(rng, 80)) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%$" for w in make(rng, 80).split())) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "same line of words\n" * 40), (None, make(rng, 70)), (2004, make(rng, 60000)), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, stats string, key int")
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 30, 2)] + [(7, None, 0), (None, 1, 0), (0, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_judge_keeps_good_and_rejects_junk(spark):
    docs, labels = fixture(spark)
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert np.mean([kept[i] for i in range(300)]) > 0.98
    assert not any(kept[1000 + i] for i in range(30))
    assert not any(kept[i] for i in (2000, 2001, 2002, 2003))
    assert kept[None]
    again = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert kept == again
    rows = quality.keep_good(docs, labels)
    assert rows.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_without_labels_base_rules_decide(spark):
    docs, labels = fixture(spark)
    got = quality.judge(docs, labels.limit(0))
    assert got.where("kept = base_failed").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_paths_equal_plain_walk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(400, 8)), rng.normal(size=(20, 8)) * 20
    forest = quality.IsolationForest(good, bad, trees=9, rows=64)
    x = np.concatenate([good[:20], bad])
    want = []
    for row in x:
        paths = []
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] + int(row[forest.feature[at]] > forest.cut[at])
            paths.append(forest.path[at])
        want.append(2 ** (-np.mean(paths) / forest.norm))
    assert np.allclose(forest.score(x), want)
    assert forest.score(bad).mean() > forest.score(good).mean() + 0.1


def test_threshold_bounds_the_loss(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("anomaly"), F.lit(1).alias("label"))
    cut = quality.threshold(df, 0.01)
    assert df.where(F.col("anomaly") >= cut).count() <= 10
    assert df.where(F.col("anomaly") >= cut - 1 / quality.BINS).count() >= 9


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_forest_decides_on_held_out_rows(spark):
    """Fitted without labels of ids divisible by 3: the held-out junk goes, the held-out good stays, and no list of limits gives the same verdict."""
    docs, labels = documents(spark, FOLDER), read(spark, FOLDER, "labels")
    measured = quality.measure(docs.select(F.col("doc_id").alias("key"), "text")).drop("text").where(~quality.base_failed()).cache()
    forest, cut = quality.calibrate(measured, labels.where("doc_id % 3 <> 0"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.with_score(measured, forest).select("key", "anomaly", *[f"stats.{x}" for x in quality.FEATURES]).collect()
    held = [r for r in rows if r["key"] in truth and r["key"] % 3 == 0]
    bad, good = ([r["anomaly"] >= cut for r in held if truth[r["key"]] == y] for y in (0, 1))
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.03
    x = np.array([[r[f] for f in quality.FEATURES] for r in rows])
    known_good = x[[truth.get(r["key"]) == 1 and r["key"] % 3 != 0 for r in rows]]
    verdict = np.array([r["anomaly"] >= cut for r in rows])
    for quantile in (0.9, 0.95, 0.99, 0.995, 1.0):
        low, high = np.quantile(known_good, 1 - quantile, axis=0), np.quantile(known_good, quantile, axis=0)
        beyond = ((x < low) | (x > high)).any(axis=1)
        assert (beyond != verdict).sum() >= 3
    measured.unpersist()
    # The same rows with each statistic dealt anew: the path lengths follow the statistics together.
    rng = np.random.default_rng(0)
    shuffled = np.stack([rng.permutation(c) for c in x.T], axis=1)
    assert ((forest.score(shuffled) >= cut) != verdict).mean() > 0.01
