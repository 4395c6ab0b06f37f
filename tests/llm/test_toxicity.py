import random
import zlib

import numpy as np
import pytest

from collatrix.llm import toxicity as T


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(n):
        said = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            said[rng.randrange(6)] += " " + rng.choice(["grumbus", "blortish", "blorty"]) + " fellow"
        rows.append((i, ". ".join(said) + ".", toxic))
    return rows


def test_held_out_accuracy_and_location(spark):
    rows = corpus()
    extra = [(9001, None), (9002, ""), (9003, "..."), (None, "grumbus"), (0, rows[0][1]), (9004, "wab " * 50000)]
    docs = spark.createDataFrame([(i, t, 0.3, 1) for i, t, _ in rows] + [(*x, 0.3, 1) for x in extra], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (9001, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    scored = T.score(docs.drop("score", "label"), model).select("doc_id", "score", T.held_out(docs.doc_id).alias("held")).collect()
    assert len(scored) == docs.count()
    got = {r["doc_id"]: r for r in scored}
    truth = {i: y for i, _, y in rows}
    held = [r for r in scored if r["doc_id"] in truth and r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored if r["doc_id"] is not None)
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held]) > 0.97
    assert [got[i]["score"] for i in (9001, 9002, 9003)] == [0.0, 0.0, 0.0]
    assert all(0 <= r["score"] <= 1 for r in scored)
    found = T.locate(docs.select("doc_id", "text"), model).collect()
    hit = [r for r in found if truth.get(r["doc_id"])]
    assert np.mean(["grumbus" in r["sentence"] or "blort" in r["sentence"] for r in hit]) > 0.97
    text = dict((i, t) for i, t, _ in rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in hit)


def test_noisy_or():
    model = T.SentenceModel({"bad": 3.0, "ban*": 1.0}, -2.0)
    one = 1 / (1 + np.exp(2.0 - 3.0))
    rest = 1 / (1 + np.exp(2.0))
    assert model.score("bad. fine. 12!") == pytest.approx(1 - (1 - one) * (1 - rest))
    assert model.score("banana") == pytest.approx(1 / (1 + np.exp(1.0)))
    for t in ("bad bad. x\ny? bad", "", "Bad!"):
        assert model.score(t) == pytest.approx(1 - np.prod([1 - p for *_, p in model.sentences(t)]))


def test_gradient_lowers_the_loss_and_one_class_gives_no_model():
    rows = corpus(200)
    texts, y = [t for _, t, _ in rows], np.array([y for *_, y in rows])
    model = T.fit_sentences(texts, y, np.ones(len(y)))
    p = np.clip([model.score(t) for t in texts], 1e-9, 1 - 1e-9)
    loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    assert loss < 0.2
    assert T.fit_sentences(texts, np.zeros(len(y)), np.ones(len(y))) is None


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit(docs, none) is None
    assert T.score(docs, None).first()["score"] == 0.0
    assert T.score(docs.limit(0), T.SentenceModel({}, 0.0)).count() == 0


def plain_training(texts, y, weight, steps):
    """The same model by loops: log odds as a start, then the noisy-or likelihood's gradient, sentence by sentence."""
    bags = [[set(T.WORD.findall(s.lower())) for s in T.SENTENCE.findall(t) if T.WORD.findall(s.lower())] for t in texts]
    docs = [set().union(*[{f for w in bag for f in T.features_of(w)} for bag in own]) if own else set() for own in bags]
    n1, n0, start = sum(y), len(y) - sum(y), {}
    for f in set().union(*docs):
        a, b = (sum(f in d for d, k in zip(docs, y, strict=True) if k == kind) for kind in (1, 0))
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        if a + b >= T.MIN_DOCS and abs(z) >= T.MIN_Z:
            start[f] = 0.1 * np.log((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1)))
    names = sorted(start)
    params = np.array([start[f] for f in names] + [-5.0])
    at = {f: i for i, f in enumerate(names)}
    m, v = np.zeros(len(params)), np.zeros(len(params))
    weight = np.asarray(weight, dtype=float) / np.sum(weight)
    for step in range(1, steps + 1):
        grad = np.append(T.RIDGE * params[:-1], 0.0)
        for own, label, share in zip(bags, y, weight, strict=True):
            zs = [params[-1] + sum(params[at[f]] for w in bag for f in T.features_of(w) if f in at) for bag in own]
            clean = sum(np.logaddexp(0, z) for z in zs)  # minus the logarithm of the chance that no sentence is toxic
            pull = share * (1.0 if not label else -1 / np.expm1(max(clean, 1e-9)))
            for bag, z in zip(own, zs, strict=True):
                dz = pull / (1 + np.exp(-z))
                grad[-1] += dz
                for w in bag:
                    for f in T.features_of(w):
                        if f in at:
                            grad[at[f]] += dz
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - T.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return dict(zip(names, params[:-1], strict=True)), params[-1]


def test_training_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(T, "STEPS", 12)
    rows = corpus(60, 5) + [(900, "", 0), (901, "...", 1)]
    y = [k for *_, k in rows]
    weight = [1.0 + 2 * k for k in y]
    model = T.fit_sentences([t for _, t, _ in rows], np.array(y), np.array(weight))
    weights, bias = plain_training([t for _, t, _ in rows], y, weight, 12)
    assert len(weights) > 3
    assert model.weights == pytest.approx(weights)
    assert model.bias == pytest.approx(bias)


def test_query_names_the_offending_sentences(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = T.op5_toxicity(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["predicted"] == (r["score"] >= 0.5)
        assert not r["sentences"] or r["predicted"]
        assert all(x["score"] >= 0.5 and texts[r["doc_id"]][x["start"] : x["end"]].strip() for x in r["sentences"])
    assert any(r["sentences"] for r in got)
