import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from collatrix.llm import repeats as R
from collatrix.llm.suffix_array import suffix_array
from tests.llm.brute import repeats


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_equals_sorting(seed):
    rng = random.Random(seed)
    for _ in range(300):
        s = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023
    for s in ([1] * 300, [1, 2] * 150, list(range(200)), list(range(200))[::-1]):
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_blocks_hold_every_string_once(monkeypatch):
    rng = random.Random(1)
    for text in ("".join(rng.choice("ab é") for _ in range(900)), "a" * 300, "ab" * 200, "x" * 49, ""):
        b = text.encode()
        _, _, first, last, place = R.blocks(b)
        covered = [i for s, e in zip(first, last, strict=True) for i in range(s, e)]
        assert covered == list(range(max(0, len(b) - R.SPAN + 1)))
        assert all(s <= p + 0 or True for s, p in zip(first, place, strict=True))
        assert all(e - 1 <= p and p + R.GRAM <= s + R.SPAN for s, e, p in zip(first, last, place, strict=True))
        monkeypatch.setattr(R, "PIECE", 200)
        again = R.blocks(b)
        monkeypatch.undo()
        covered = [i for s, e in zip(again[2], again[3], strict=True) for i in range(s, e)]
        assert covered == list(range(max(0, len(b) - R.SPAN + 1)))
        if len(b) >= R.SPAN:
            anchor_of = lambda x: {i: int(p) for s, e, p in zip(x[2], x[3], x[4], strict=True) for i in range(s, e)}
            assert anchor_of(again) == {i: int(p) for s, e, p in zip(first, last, place, strict=True) for i in range(s, e)}


def corpus(seed=0):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("the of and en la é zu".split()) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
    passages = [say(14) for _ in range(4)]
    rows = []
    for i in range(60):
        body = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            p = rng.choice(passages)
            body = body[:at] + p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)] + body[at:]
        rows.append((i * 3, body))
    rows += [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 60), (504, "ab" * 100), (505, rows[20][1]), (506, rows[20][1] + "!"), (507, "é" * 80), (508, "x" + "é" * 80), (509, "z" * 49), (510, "z" * 49), (511, say(9000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("part", "limits"), [(R.PART, {}), (4000, {}), (4000, {"split": 2}), (4000, {"sample": 1, "sample_hot": 3}), (R.PART, {"split": 1, "sample": 2, "sample_hot": 2})])
def test_equals_plain_search(spark, monkeypatch, part, limits):
    monkeypatch.setattr(R, "PART", part)
    monkeypatch.setattr(R, "CHUNK", 9000)
    monkeypatch.setattr(R, "ARRAY", 2000)
    rows = corpus(len(limits))
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, id int, spans binary").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in R.remove_repeats(df, **limits).collect()}
    want = repeats(rows)
    assert got == {k: v[:4] for k, v in want.items()}
    if limits:
        return
    cut = R.cut_repeats(df)
    assert cut.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    for k, (n, gone, _, _, kept) in want.items():
        if gone and gone < n and kept.decode("utf-8", "ignore"):
            assert left[k] == kept.decode("utf-8", "ignore")
        elif gone:
            assert k not in left


def test_null_ids_and_repeated_rows(spark):
    text = "some words that are long enough to be a span of fifty bytes, surely"
    df = spark.createDataFrame([(None, text), (None, text), (2, text), (2, text), (3, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in R.remove_repeats(df).collect())
    n = len(text)
    assert got == [("2", 0), ("2", 0), ("3", n), ("None", 0), ("None", 0)]
    assert R.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "binary", "decimal(20,2)", "timestamp", "struct<a: bigint, b: string>"])
def test_ids_of_any_type_with_an_order(spark, kind):
    """Text ids: 10 is before 9, so the passage stays in 10."""
    say = "a passage of sixty bytes or so that two documents have alike, no more"
    texts = {9: "x1 " + say, 10: say + " y234", 200: "all its own, and long enough not to be passed over by length", None: say}
    column = {"struct<a: bigint, b: string>": "struct(n AS a, CAST(n AS string) AS b)", "binary": "CAST(CAST(n AS string) AS binary)"}.get(kind, f"CAST(n AS {kind})")
    df = spark.createDataFrame(list(texts.items()), "n long, text string").selectExpr("n", f"IF(n IS NULL, NULL, {column}) AS doc_id", "text")
    whole = {r["n_bytes"]: r["n_removed"] for r in R.remove_repeats(df).collect()}
    cut = len(texts[9]) if kind in ("string", "binary") else len(texts[10])
    assert whole == {len(t): (len(say) if len(t) == cut else 0) for t in texts.values()}
    assert R.cut_repeats(df).count() == 4


def test_a_hot_anchor_is_split(spark):
    """A passage in every document with different text around it: one block per document at each edge."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = say(120)
    rows = [(i, say(rng.randint(0, 40)) + passage + say(rng.randint(0, 40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for limits in ({"split": 20}, {"sample": 1, "sample_hot": 40}, {}):
        got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in R.remove_repeats(df, **limits).collect()}
        assert got == {k: (v[1], v[3]) for k, v in repeats(rows).items()}


@pytest.mark.parametrize("limits", [{}, {"split": 1}])
def test_passages_that_a_document_has_twice(spark, limits):
    """An earlier document has a part of the passage: it goes from every copy."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    rows = []
    for i in range(40):
        passage = say(160)
        rows.append((i, say(20) + passage[: 60 + 2 * i] + say(20)))
        rows.append((100 + i, passage + say(30) + passage + passage))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in R.remove_repeats(df, **limits).collect()}
    assert got == {k: v[1:4] for k, v in repeats(rows).items()}


def test_a_passage_in_two_texts_of_an_id(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows, want = [], []
    for i in range(20):
        passage, n = say(160), 60 + 4 * i
        rows += [(i, "0" + passage[:n] + "0"), (100 + i, "1" + passage + "1"), (100 + i, "22" + passage + "2")]
        want += [(i, n + 2, 0), (100 + i, 162, n), (100 + i, 163, n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in R.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)


def test_very_many_equal_rows_of_an_id(spark):
    text = "some words that are long enough to be a span of fifty bytes, surely"
    rows = [(7, text)] * 3000 + [(8, "and " + text)] * 3
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, 0, 3000), (8, len(text), 3)]


def test_chunks_send_runs_not_a_table_of_documents_by_parts():
    """What a chunk sends is bounded by its blocks, however many parts there are."""
    pdf = pd.DataFrame({"id": range(50), "text_hash": range(50), "text": [f"{i} " * 40 for i in range(50)]})
    for hot in (np.zeros(0, dtype=np.uint64), np.sort(R.blocks(pdf["text"][7].encode())[0])):
        sizes = []
        for parts in (10, 100_000):
            held = [(i, i, *R.blocks(t.encode())[:2]) for i, t in enumerate(pdf["text"])]
            flush = dict(zip(R.cut_chunks(parts, hot).__code__.co_freevars, R.cut_chunks(parts, hot).__closure__, strict=True))["flush"].cell_contents
            out = flush(held, "0-0")
            sizes.append(sum(len(x) for c in ("ids", "texts", "docs", "counts", "low", "high") for x in out[c] if x is not None))
        n = sum(len(h[2]) for h in held)
        assert sizes[1] <= 28 * n + 50 * 50
