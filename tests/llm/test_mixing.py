import random
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from collatrix.llm import mixing as M


def plain_targets(sizes, weights, most=3):
    """Water filling by repeating: full sources leave, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def corpus(spark, seed=0):
    rng = random.Random(seed)
    sources = ["a", "Z", "é", None, "src10", "src2", "tiny"]
    rows = []
    for i in range(400):
        s = rng.choices(sources, [30, 3, 3, 2, 10, 5, 1])[0]
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)), s))
    rows += [(1000, None, "a"), (1001, "", "Z"), (1002, "x " * 3000, "src2"), (1003, " \n", "none"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, source string, size int, target string"), rows


def test_targets_sizes_and_bounds(spark):
    docs, rows = corpus(spark)
    got = M.queue(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, (5, 2, 1))
    taken = defaultdict(int)
    biggest = max(r["size"] for r in got)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= biggest
    budget = sum(sizes.values())
    assert budget - biggest < sum(taken.values()) <= budget
    assert sorted(map(str, M.queue(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_equals_sql(spark):
    docs, rows = corpus(spark, 3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, t, s in rows], columns=["doc_id", "text", "source"]).astype({"text": object, "source": object}))
    want = sorted(str(tuple(r)) for r in con.execute("SELECT doc_id, size, source_size, round(target, 6), taken FROM (" + M.OP6_SQL + ")").fetchall())
    queued = M.queue(docs).select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6), (F.col("copies") * F.col("size")))
    assert sorted(str(tuple(r)) for r in queued.collect()) == want


def plain_queue(queued, weights=(5, 2, 1), passes=3):
    """Copies by row number: a heap of sources, the one whose next document finishes first is served, until the budget would be passed."""
    import heapq

    by_source = defaultdict(list)
    for i, r in enumerate(queued):
        if r["size"]:
            by_source[r["source"]].append((r["until"], i, r["size"]))
    names = sorted({r["source"] for r in queued}, key=lambda s: (s is None, s))
    heap = []
    for n, s in enumerate(names):
        line, served = iter(sorted(by_source[s]) * passes), 0
        for _, i, size in line:
            heapq.heappush(heap, ((served + size) / weights[n % len(weights)], n, i, size, served + size, line))
            break
    copies, left = defaultdict(int), sum(r["size"] for r in queued)
    while heap:
        _, n, i, size, served, line = heapq.heappop(heap)
        if size > left:
            break
        left -= size
        copies[i] += 1
        for _, j, more in line:
            heapq.heappush(heap, ((served + more) / weights[n % len(weights)], n, j, more, served + more, line))
            break
    return copies


def test_copies_equal_a_plain_queue(spark):
    for seed in range(3):
        docs, _ = corpus(spark, seed + 10)
        queued = M.queue(docs).collect()
        want = plain_queue(queued)
        assert [r["copies"] for r in queued] == [want[i] for i in range(len(queued))]
        assert sum(want.values()) > 300


def test_columns_of_the_mix_keep_apart_from_the_rows(spark):
    rows = [(i, "w " * (3 + i), "a", 7, "t", "x", 0, 1) for i in range(20)] + [(3, "w " * 6, "a", 7, "t", "x", 0, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass int, mix_time string, ident_0 string, `until` int, pass int")
    got = M.mix(docs)
    assert got.columns == [*docs.columns, "mix_pass_", "mix_time_"]
    taken = got.collect()
    assert all((r["mix_pass"], r["mix_time"], r["ident_0"], r["until"], r["pass"]) == (7, "t", "x", 0, 1) for r in taken)
    # Of one source all rows are taken once, those that repeat as often as they are there.
    assert sorted(r["doc_id"] for r in taken) == sorted(r[0] for r in rows)
    assert [r["mix_time_"] for r in taken] == sorted(r["mix_time_"] for r in taken)


def test_many_sources_go_through_ranges(spark):
    rows = [(i, "w " * (1 + i % 13), f"site{i % 97}.example") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, sizes, taken = M.queue(docs).collect(), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
    want = plain_targets(sizes, (5, 2, 1))
    assert all(abs(taken[s] - t) <= 2 * 13 for s, t in want.items())


def test_mix_is_in_order_of_virtual_time(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    rows = M.mix(docs).collect()
    times = [r["mix_time"] for r in rows]
    assert times == sorted(times)
    words = defaultdict(int)
    for r in rows[: len(rows) // 2]:
        words[r["source"]] += len(r["text"].split())
    assert words["a"] / sum(words.values()) == pytest.approx(5 / 7, abs=0.05)
    copies = defaultdict(int)
    for r in rows:
        copies[r["doc_id"]] += 1
    want = {r["key"]: r["copies"] for r in M.queue(docs).collect() if r["copies"]}
    assert copies == want


def test_sources_that_run_out_are_served_by_weight_until_then(spark):
    rows = [(i, "w " * 10, "a") for i in range(4)] + [(100 + i, "w " * 10, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = M.mix(docs).collect()
    served = [r["source"] for r in taken]
    assert served.count("a") == 12
    last = max(i for i, s in enumerate(served) if s == "a")
    assert served[: last + 1].count("b") == pytest.approx(12 * 2 / 5, abs=1)
    served_words = defaultdict(int)
    for r in taken:
        served_words[r["source"]] += 10
        assert r["mix_time"] == pytest.approx(served_words[r["source"]] / {"a": 5, "b": 2}[r["source"]])
    assert abs(10 * len(taken) - 10 * len(rows)) <= 10


def test_null_and_repeated_ids_are_taken_as_often_as_queued(spark):
    rows = [(None, f"n{i} " * (3 + i), "ab"[i % 2], "en") for i in range(12)]
    rows += [(7, f"r{i} " * 5, "a", "en") for i in range(9)] + [(8, "same text", "b", lang) for lang in ("en", "en", "fr", None)]
    rows += [(100 + i, "w " * 20, "a", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for df in (docs, docs.dropDuplicates()):
        queued = M.queue(df).collect()
        taken = M.mix(df).collect()
        want, got, each = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in queued:
            want[r["key"], r["source"], r["size"]] += r["copies"]
        for r in taken:
            got[r["doc_id"], r["source"], len(r["text"].split())] += 1
            each[r["doc_id"], r["text"], r["source"], r["lang"], r["mix_pass"]] += 1
        assert got == {k: n for k, n in want.items() if n}
        kept = list(map(tuple, df.collect()))
        assert all(n <= kept.count(k[:4]) for k, n in each.items())
        assert len({r["text"] for r in taken if r["doc_id"] is None}) > 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.queue(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["copies"]) for r in M.queue(blank).collect()] == [(0, 0), (0, 0)]
