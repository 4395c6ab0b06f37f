import os
import random

import numpy as np
import pytest

from collatrix.llm import near_duplicates as N
from tests.llm.brute import near_classes, shingle_bag


def corpus(seed=0, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 9999)}"
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def test_equals_plain_classes(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "ab " * 30000), (1006, "ab " * 29000)]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, row int, sig binary")
    got = N.classes(df).collect()
    want = near_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(set(want.values()))
    sizes = {r["doc_id"]: r["class_size"] for r in got}
    assert all(sizes[k] == list(want.values()).count(c) for k, c in want.items())


@pytest.mark.parametrize(("blocks", "rounds"), [(100, 2), (1, 2), (1, 0), (1, 1)])
def test_large_families_in_blocks(spark, monkeypatch, blocks, rounds):
    monkeypatch.setattr(N, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(N, "FAMILY_BLOCKS", blocks)
    monkeypatch.setattr(N, "HEAD_ROUNDS", rounds)
    monkeypatch.setattr(N, "HOT_ROWS", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"z{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()} == near_classes(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x y"), (None, "q")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in N.classes(df).collect())
    assert got == [("1", "1", False), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["text"] for r in kept.collect()) == ["a b c d e f", "q", "x y"]
    assert N.classes(df.limit(0)).count() == 0


def test_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = N.unit_cells(rng.integers(0, 200, rng.integers(30, 400)).astype(np.uint64))
        keep = rng.random(len(a)) < rng.uniform(0.4, 1)
        b = np.concatenate([a[keep], rng.integers(1, 2**62, int((~keep).sum())).astype(np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = N.signatures([a, b])
        errors.append((x == y).mean() - j)
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.06


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sets = [rng.integers(1, 2**62, n).astype(np.uint64) for n in (0, 1, 3, 50, 3000)]
    together = N.signatures(sets)
    assert np.isinf(together[0]).all()
    for s, row in zip(sets[1:], together[1:], strict=True):
        assert (N.signatures([s])[0] == row).all()
        assert np.isfinite(row).all()


@pytest.mark.parametrize("blocks", [100, 1])
def test_chained_families(spark, monkeypatch, blocks):
    """Texts that shift word by word: neighbours are similar, the ends of the chain have nothing in common; stragglers share bands only."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", 10)
    monkeypatch.setattr(N, "FAMILY_BLOCKS", blocks)
    monkeypatch.setattr(N, "HOT_ROWS", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(110)]
    rows += [(1000 + i, " ".join(words[40 * i : 40 * i + 45] + [f"q{i}{j}" for j in range(14)])) for i in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)


def test_many_null_and_equal_ids_meet_their_own_text_only(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{i}x{j}" for j in range(40)]
        rows += [(None if i % 2 else 7, " ".join(base)), (None if i % 2 else 7, " ".join([*base, f"more{rng.randint(0, 9)}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = N.sign(df, "doc_id", "text")
    filled = N.with_cells(signed, df, "doc_id", "text", False)
    assert filled.count() == len(rows)
    before = filled.drop("cells")
    assert before.count() == len(rows)
    joined = [r["class_size"] for r in N.classes(df).collect()]
    assert joined == [2] * len(rows)
    # Rows that repeat are one row of the join.
    again = df.unionByName(df.limit(1)).unionByName(df.limit(1))
    assert sorted(r["class_size"] for r in N.classes(again).collect()) == [2] * (len(rows) - 2) + [4] * 4


def test_hot_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_ROWS", 3)
    rows = corpus(5) + [(2000 + i, "the very same text in many rows of the table") for i in range(50)]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == near_classes(rows)


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_recall_against_all_pairs(spark):
    """All pairs of sf0.01 that share a shingle, compared exactly: every link of 0.8 or more is inside a class, and no class holds anything else."""
    from collections import Counter, defaultdict

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    bags = [shingle_bag(t) for _, t in docs]
    where = defaultdict(list)
    for i, bag in enumerate(bags):
        for x in bag:
            where[x].append(i)
    links, up = 0, list(range(len(docs)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    found = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    inside = 0
    for i, bag in enumerate(bags):
        for j, both in Counter(j for x in bag for j in where[x] if j > i).items():
            if both >= 0.8 * (len(bag) + len(bags[j]) - both):
                links += 1
                inside += found[docs[i][0]] == found[docs[j][0]]
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert links > 50
    assert inside == links
    least = {}
    for i, (k, _) in enumerate(docs):
        if bags[i]:
            least[find(i)] = min(least.get(find(i), k), k)
    assert all(found[k] == least[find(i)] for i, (k, _) in enumerate(docs) if bags[i])
