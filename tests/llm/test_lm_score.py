import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from collatrix.llm import lm_score as L
from collatrix.llm.store import documents, read


def plain_scores(rows, target):
    """Per row the losses of every token, target then background, by counting all other rows."""
    bags = [(t or "").lower().split() for _, t in rows]
    out = []
    for i, words in enumerate(bags):
        losses = []
        for only in (True, False):
            others = [b for j, b in enumerate(bags) if j != i and (not only or rows[j][0] in target)]
            one = Counter(w for b in others for w in b)
            two = Counter(p for b in others for p in zip([None, *b], b, strict=False))
            last = Counter(w.encode()[-3:] for b in others for w in b)
            starts, total = sum(bool(b) for b in others), one.total()
            own = []
            for v, w in zip([None, *words], words, strict=False):
                law = 1 / L.ENDINGS
                law = ((1 - L.UNIFORM) * last[w.encode()[-3:]] / total + L.UNIFORM * law if total else law) / L.ALIKE
                share = (1 - L.UNIFORM) * one[w] / total + L.UNIFORM * law if total else law
                before = starts if v is None else one[v]
                own.append(-math.log2(L.PAIR * two[v, w] / before + (1 - L.PAIR) * share if before else share))
            losses.append(own)
        out.append(list(zip(*losses, strict=True)))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    say = lambda n, vocabulary: " ".join(rng.choice(vocabulary.split()) for _ in range(n))
    rows = [(i, say(rng.randint(1, 25), "the cat sat on a mat and The dog")) for i in range(25)]
    rows += [(100 + i, say(rng.randint(1, 25), "cat %% $$ on ## é mat the")) for i in range(15)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "é"), (204, "word " * 3000), (205, "a a a a"), (206, rows[0][1])]
    rows += [(None, "the cat"), (None, "another text"), (0, "a second row of an id"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize(("chunk", "part"), [(L.CHUNK, L.PART), (400, 300)])
def test_losses_equal_plain_counting(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "PART", part)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1.0, "x", 5) for r in rows], "doc_id long, text string, score double, target string, copies int").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(102, 0), (5, 0), (None, 1), (3, None), (206, 1)], "doc_id long, quality int")
    target = L.good_documents(labels)
    chosen = {r["doc_id"] for r in target.collect()}
    assert chosen == {*range(12), 206} - {5}
    got = L.score(docs, target, with_tokens=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for (k, _), losses in zip(rows, plain_scores(rows, chosen), strict=True):
        want[k, tuple((round(a, 6), round(b, 6)) for a, b in losses)] += 1
    assert Counter((r["doc_id"], tuple((round(x["target"], 6), round(x["background"], 6)) for x in r["token_losses"])) for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["token_losses"])
        if not r["n_tokens"]:
            assert (r["loss_target"], r["loss_background"], r["score"]) == (None, None, None)
            continue
        means = [np.mean([x[c] for x in r["token_losses"]]) for c in ("target", "background")]
        assert means == pytest.approx([r["loss_target"], r["loss_background"]])
        assert r["score"] == pytest.approx(means[1] - means[0])


def test_a_text_that_occurs_twice_is_known_and_no_text_is_known_by_itself(spark):
    rng = random.Random(1)
    say = lambda: " ".join(f"w{rng.randint(0, 300)}" for _ in range(60))
    rows = [(i, say()) for i in range(200)]
    rows += [(1000, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    got = {r["doc_id"]: r for r in L.score(docs, target).collect()}
    once = [r["loss_background"] for k, r in got.items() if k not in (7, 1000)]
    assert max(got[7]["loss_background"], got[1000]["loss_background"]) < min(once) - 2
    # Documents of the target have no more to gain from it than others that are as random.
    means = [np.mean([r["score"] for k, r in got.items() if k not in (7, 1000) and k % 2 == odd]) for odd in (0, 1)]
    assert abs(means[0] - means[1]) < 0.5


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert L.score(docs.limit(0), none).count() == 0
    got = {r["doc_id"]: r for r in L.score(docs, none).collect()}
    # Nothing is left of either model without the only text.
    assert got[1]["loss_target"] == pytest.approx(math.log2(L.VOCABULARY)) == got[1]["loss_background"]
    text_ids = spark.createDataFrame([("x", "a b"), ("y", "a b c")], "doc_id string, text string")
    assert L.score(text_ids, text_ids.select("doc_id").limit(1)).count() == 2


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_good_documents_score_above_bad_ones(spark):
    labels = read(spark, FOLDER, "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = L.score(documents(spark, FOLDER), L.good_documents(labels)).where("n_tokens >= 50").collect()
    good, bad = (np.array([r["score"] for r in got if truth.get(r["doc_id"]) == y]) for y in (1, 0))
    assert len(good) > 100 and len(bad) > 10
    assert (good[:, None] > bad[None, :]).mean() > 0.95
