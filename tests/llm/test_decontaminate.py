import random
import time

import pytest
from pyspark.sql import functions as F

from collatrix.llm import decontaminate as D
from tests.llm.brute import hits


def compare(spark, docs, items):
    d = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, row int, places string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, kind int")
    got = D.decontaminate(d, b).collect()
    assert len(got) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    for r in got:
        want = hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == want, r
        assert r["n_items"] == len(want[2])
    return d, b


def test_equals_plain_search(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("aa bb cc dd".split()) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12)]
    items = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(25))) for i in range(20, 26)] + items[:2] + [(3, "q r s"), (4, "Zz"), (5, "a b c d e f g h i")]
    docs = [(i, say(rng.randint(0, 40))) for i in range(25)]
    for i in range(25, 60):
        words = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        body = rng.choice(items)[1].split()
        at, n = rng.randint(0, len(words)), rng.randint(1, 20)
        docs.append((i, " ".join(words[:at] + body[:n] + words[at:])))
    compare(spark, docs, items)


def test_edges(spark):
    item = " ".join(f"v{i}" for i in range(12))
    docs = [
        (0, None),
        (1, ""),
        (2, "!!! ???"),
        (3, item.upper()),
        (4, ", ".join(item.split()[:10])),
        (5, " ".join(item.split()[:9])),
        (6, "É " + item + " é"),
        (7, "x " * 50000 + item),
        (8, item),
        (8, item),
    ]
    items = [(1, item), (1, item), (10, None), (11, ""), (12, "É"), (None, " ".join(item.split()[2:]))]
    compare(spark, docs, items)


def test_empty_tables_and_drop(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c"), (None, "k " * 10), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "k " * 12)], "item_id long, text string")
    assert D.decontaminate(none_d, bench).count() == 0
    assert [r["n_hit"] for r in D.decontaminate(docs, none_b).collect()] == [0, 0, 0]
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2"]


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    item = " ".join(f"v{i}" for i in range(12))
    compare(spark, [(1, item), (2, "a b")], [(1, item)])


@pytest.mark.parametrize("n", [10, 11, 15, 40])
def test_every_shared_span_keeps_a_gram(spark, n):
    """The guarantee of winnowing: a span that two texts share has a kept gram in both."""
    rng = random.Random(n)
    span = [f"s{rng.randint(0, 3)}" for _ in range(n)]
    rows = [(" ".join([f"a{rng.randint(0, 3)}" for _ in range(8)] + span + [f"b{rng.randint(0, 3)}" for _ in range(8)]),) for _ in range(6)] + [(" ".join(span),)]
    df = spark.createDataFrame(rows, "t string")
    h = D.word_hashes(df.t)
    kept = [{x["gram"] for x in r["k"]} for r in df.select(D.around(h, D.grams(h, D.GRAM)).alias("k")).collect()]
    plain = []
    for (text,) in rows:
        g = [x["g"] for x in df.where(df.t == text).select(F.explode(D.grams(D.word_hashes(df.t), D.GRAM)).alias("g")).collect()][: len(text.split()) - D.GRAM + 1]
        plain.append({min(g[i : i + 6]) for i in range(len(g) - 5)})
    assert kept == plain
    assert set.intersection(*kept) & kept[-1]


def test_long_texts_that_hit_everywhere_take_time_in_proportion(spark):
    def seconds(n):
        rng = random.Random(n)
        text = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
        docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")
        start = time.perf_counter()
        got = D.decontaminate(docs, items).collect()[0]
        assert (got["n_words"], got["n_hit"], got["n_items"], got["items"]) == (n, n, 1, ["1"])
        return time.perf_counter() - start

    seconds(2000)
    short, long = seconds(20_000), seconds(80_000)
    assert long <= 2 * 4 * short


def test_rows_without_places_spread_in_the_shuffled_join(spark, monkeypatch):
    """A corpus of which hardly anything hits: with nulls as keys all rows would meet in one task."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    item = " ".join(f"v{i}" for i in range(12))
    docs = [(i, f"clean text number {i}") for i in range(300)] + [(1000, "so " + item)]
    compare(spark, docs, [(1, item), (2, "q r s")])
    found = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.where("n_hit = 0").count() == 300
    kept = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
