import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.operators import audits, contracts, coverage, dossier, evaluate, graph, groupstats, ingest, ranking, regions, sessions, vectors


def incidence(spark, photos):
    return spark.createDataFrame([(p, g) for p, gs in photos.items() for g in gs], "item string, grp int")


PHOTOS = {"a": [0, 1], "b": [0], "c": [1], "d": [2]}


def test_planner_prefers_gain_then_id(spark):
    inc = incidence(spark, PHOTOS)
    assert [x[1] for x in coverage.greedy_plan(inc, 1)] == ["a"]
    assert [x[1] for x in coverage.greedy_plan(inc, 4)] == ["a", "b", "c", "d"]
    weights = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 1.0)], "grp int, weight double")
    assert [x[1] for x in coverage.greedy_plan(inc, 4, weights)] == ["d"]
    done = spark.createDataFrame([("a",)], "item string")
    assert [x[1] for x in coverage.greedy_plan(inc, 4, reviewed=done)] == ["b", "c", "d"]
    with pytest.raises(ValueError, match="budget"):
        coverage.greedy_plan(inc, 0)


@pytest.mark.parametrize("fetch", [1, 3, 1000])
def test_planner_equals_plain_greedy(spark, fetch):
    rng = random.Random(3)
    photos = {f"p{i:02}": sorted(rng.sample(range(12), rng.randint(1, 5))) for i in range(30)}
    seen, pool, want = {}, dict(photos), []
    while len(want) < 8:
        gain = {p: round(sum(0.5 for g in gs if seen.get(g, 0) < 2), 12) for p, gs in pool.items()}
        best = min(gain, key=lambda p: (-gain[p], p))
        if gain[best] <= 0:
            break
        want.append((len(want) + 1, best, gain[best]))
        for g in pool.pop(best):
            seen[g] = seen.get(g, 0) + 1
    assert coverage.greedy_plan(incidence(spark, photos), 8, fetch=fetch) == want


def test_components_forest_and_extras(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    edges = spark.createDataFrame([(a, b, round(rng.random(), 3)) for a, b in pairs], "a long, b long, weight double")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {r["node"]: r["root"] for r in graph.connected_components(edges).collect()} == {x: find(x) for x in root}
    rows = edges.collect()
    up, best = {x: x for x in root}, 0.0

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in sorted(rows, key=lambda r: (-r["weight"], r["a"], r["b"])):
        if top(r["a"]) != top(r["b"]):
            up[top(r["a"])] = top(r["b"])
            best += r["weight"]
    forest = graph.spanning_forest(edges)
    assert abs(sum(r["weight"] for r in forest.collect()) - best) < 1e-9
    extra = graph.capped_extra_edges(edges, forest).collect()
    ends = [x for r in extra for x in (r["a"], r["b"])]
    assert max([ends.count(x) for x in ends], default=0) <= 2


def test_communities_of_two_cliques(spark):
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in [*cliques, (4, 10)]], "a long, b long, weight double")
    found = {r["node"]: r["label"] for r in graph.communities(edges).collect()}
    assert {found[i] for i in range(5)} == {0}
    assert {found[i] for i in range(10, 15)} == {1}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "a long, b long, weight double")
    assert graph.connected_components(edges).count() == 0
    assert graph.spanning_forest(edges).count() == 0


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    bank = spark.createDataFrame([(i, i % 6, i % 4, x[i].tolist()) for i in range(60)], "id long, parent long, family long, v array<double>")
    got = {(r["src"], r["rank"]): r["dst"] for r in vectors.search(bank.where("id % 20 = 0"), bank, 3, "parent").collect()}
    for q in (0, 20, 40):
        order = sorted((i for i in range(60) if i % 6 != q % 6), key=lambda i: (-round(float(x[q] @ x[i]), 9), i))
        assert [got[q, k] for k in (1, 2, 3)] == order[:3]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.5, 0)], "s double, y int")
    assert evaluate.auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert evaluate.auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_ridge_from_sums_equals_ridge(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(3)
    assert np.allclose(evaluate.ridge_from(evaluate.normal_equations(df, "x", "y"), 0.5), evaluate.ridge(x, y, 0.5))


def test_statistics_edges(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "g string, k string")
    got = {r["g"]: r["entropy"] for r in groupstats.entropy(df, "g", "k").collect()}
    assert got == {"a": 0.0, "b": pytest.approx(1.0)}
    same = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "x int, y int")
    assert groupstats.adjusted_rand(same, "x", "y").first()["ari"] == 1.0


def test_dossier(spark):
    h = "A" * 64
    photos = spark.createDataFrame([(0, "p0", h, True, False), (1, "p1", h.lower(), True, False), (2, "p2", "short", False, False), (3, "p3", "b" * 64, True, True)], "pos int, photo_id string, sha256 string, readable boolean, ambiguous boolean")
    supports = spark.createDataFrame([(0, "p1", "f", "r", 0.5), (1, "p1", "f", "r2", None)], "pos int, photo_id string, family string, region string, strength double")
    owners = spark.createDataFrame([(0, "p1", "r", "supported"), (1, "p1", "r", "odd")], "pos int, photo_id string, region string, owner_status string")
    unique = dossier.consolidate(photos).collect()
    assert sorted((r["photo_id"], r["copies"]) for r in unique) == [("p0", 2), ("p2", 1), ("p3", 1)]
    entries, requests = dossier.build(photos, supports, owners)
    assert [tuple(r) for r in entries.collect()] == [("p0", "f", "r", 0.5, "unresolved")]
    assert {tuple(r) for r in requests.collect()} == {("p2", "unreadable"), ("p3", "unsupported"), ("p3", "ambiguous")}
    own = spark.createDataFrame([("e", "note", "x")], "entry_id string, field string, value string")
    change = spark.createDataFrame([(0, "e", "note", "y"), (1, "e", "note", "z")], "pos int, entry_id string, field string, value string")
    revised, audit = dossier.correct(own, change)
    assert [r["value"] for r in revised.collect()] == ["z"]
    assert audit.count() == 2
    with pytest.raises(ValueError, match="can't be edited"):
        dossier.correct(own, change.withColumn("field", F.lit("hidden")))


def test_revision_store(spark, tmp_path):
    store = sessions.RevisionStore(spark, str(tmp_path / "r"))
    store.create("d", "one")
    assert store.revise("d", "two", 1) == 2
    with pytest.raises(contracts.ContractError):
        store.revise("d", "three", 1)
    assert (store.get("d")["state"], store.get("d", 1)["state"]) == ("two", "one")
    with pytest.raises(KeyError):
        store.get("nobody")
    assert [r["revision"] for r in store.latest().collect()] == [2]


def test_stale_versions(spark):
    df = spark.createDataFrame([(1, "s", 1), (2, "s", 1), (3, "s", 2)], "n int, s string, v int")
    got = {r["n"]: r["is_accepted"] for r in sessions.accepted(df, "s", "v", "n").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_regions(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 9.5), (1, 3, 0.7, 2.0, 2.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "photo long, region long, score double, x0 double, y0 double, x1 double, y1 double")
    got = {r["region"]: r["kept"] for r in regions.suppress(df).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert {(r["region"], r["holder"]) for r in regions.holders(df).collect()} == {(3, 2)}


def test_content_keys(spark):
    df = spark.createDataFrame([("A" * 64 + " ", "p"), ("x", "q")], "d string, k string")
    assert [r[0] for r in df.select(ingest.content_key(F.col("d"), F.col("k"))).collect()] == ["sha256:" + "a" * 64, "photo:q"]


def test_priorities(spark):
    df = spark.createDataFrame([("b", 0.5, 1), ("a", 0.5, 0), ("c", 0.9, 1)], "canonical_id string, score double, target int")
    got = ingest.priorities(df)
    assert "target" not in got.columns
    assert [r["canonical_id"] for r in got.orderBy("rank").collect()] == ["c", "a", "b"]
    with pytest.raises(contracts.ContractError):
        ingest.priorities(df.unionByName(df))
    for bad in (float("nan"), 1.5):
        with pytest.raises(Exception, match="not from 0 to 1"):
            ingest.priorities(df.withColumn("score", F.lit(bad))).collect()


def test_shuffles_are_fixed_and_differ(spark):
    df = spark.range(50)
    got = {(r["seed"], r["rank"]): r["id"] for r in ingest.shuffled(df, "id", [1, 2]).collect()}
    again = {(r["seed"], r["rank"]): r["id"] for r in ingest.shuffled(df.repartition(3), "id", [1, 2]).collect()}
    assert got == again
    assert [got[1, i] for i in range(1, 51)] != [got[2, i] for i in range(1, 51)]


def test_global_order_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 30), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, s int, n int").repartition(7)
    got = {r["id"]: (r["place"], r["total"]) for r in ranking.in_order(df, [F.desc("s"), "id"], {"total": "n"}, "place").collect()}
    total = 0
    for place, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += n
        assert got[i] == (place, total)
    assert ranking.in_order(df.limit(0), ["id"], {"total": "n"}, "place").count() == 0


@pytest.mark.parametrize(("least", "caps"), [(0.5, (16, 64)), (0.8, (16, 64)), (0.8, (4, 10))])
def test_weighted_jaccard_links_equal_all_pairs(spark, monkeypatch, least, caps):
    """Sets of 1 to 33 groups with even and uneven weights, at each of the levels."""
    monkeypatch.setattr(groupstats, "THREE_MOST", caps[0])
    monkeypatch.setattr(groupstats, "TWO_MOST", caps[1])
    rng = random.Random(7)
    weight = {g: rng.choice([0.5, 1.0, 2.0, rng.uniform(0.1, 6)]) for g in range(40)}
    base = [rng.sample(range(40), rng.choice([1, 2, 3, 5, 8, 15, 20, 30])) for _ in range(12)]
    items = {}
    for i in range(120):
        own = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5 and len(own) > 1:
                own.discard(rng.choice(sorted(own)))
            else:
                own.add(rng.randrange(40))
        items[i] = frozenset(own)
    incidence = spark.createDataFrame([(i, g) for i, own in items.items() for g in own], "item int, grp int")
    classes, links = groupstats.weighted_jaccard(incidence, spark.createDataFrame(list(weight.items()), "grp int, weight double"), least)
    first = {}
    for i, own in items.items():
        first.setdefault(own, i)
    assert {r["item"]: r["class_id"] for r in classes.collect()} == {i: first[own] for i, own in items.items()}
    want = {}
    for (a, i), (b, j) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2):
        share = sum(weight[g] for g in a & b) / sum(weight[g] for g in a | b)
        if share >= least - 1e-9:
            want[i, j] = share
    got = {(r["a"], r["b"]): r["similarity"] for r in links.collect()}
    assert links.count() == len(got)
    assert got == pytest.approx(want)


def test_bootstrap_equals_plain_resampling(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 30)), float(rng.random()), rng.randint(0, 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, s double, t double, y int")
    got = {(r["draw"], r["model"]): r["auc"] for r in evaluate.bootstrap_auc(df.repartition(5), ["s", "t"], "y", "k", draws=20, seed=4).collect()}
    hashes = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    weights = evaluate.draw_weights(np.array([hashes[r[0]] for r in rows]), 20, 4)
    y = np.array([r[3] for r in rows])
    assert weights.mean() == pytest.approx(1, abs=0.05) and weights.var() == pytest.approx(1, abs=0.1)
    for c, name in ((1, "s"), (2, "t")):
        x = np.array([r[c] for r in rows])
        wins = (x[y == 1][:, None] > x[y == 0][None, :]) + 0.5 * (x[y == 1][:, None] == x[y == 0][None, :])
        for draw in range(20):
            a, b = weights[y == 1, draw], weights[y == 0, draw]
            assert got[draw, name] == pytest.approx(a @ wins @ b / (a.sum() * b.sum()))
    delta = evaluate.paired_delta(evaluate.bootstrap_auc(df, ["s", "t"], "y", "k", draws=20, seed=4), "t", "s").first()
    plain = np.array([got[d, "t"] - got[d, "s"] for d in range(20)])
    assert (delta["mean"], delta["above"]) == (pytest.approx(plain.mean()), (plain > 0).mean())
    assert delta["low"] <= delta["mean"] <= delta["high"]


def plain_quality(edges, label, resolution):
    total, inner, degree = sum(w for *_, w in edges), 0.0, {}
    for a, b, w in edges:
        inner += w * (label[a] == label[b])
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0.0) + w
    return inner / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values())


@pytest.mark.parametrize("seed", range(2))
def test_communities_are_connected_and_no_single_move_gains(spark, seed):
    rng = random.Random(seed)
    edges = {}
    for _ in range(260):
        a, b = rng.randrange(60), rng.randrange(60)
        if a != b and (a % 5 == b % 5 or rng.random() < 0.15):
            edges[min(a, b), max(a, b)] = rng.uniform(0.2, 1)
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, weight double")
    for resolution in (0.5, 1.0):
        labels = graph.communities(df, resolution, seed)
        assert graph.disconnected_communities(df, labels).count() == 0
        label = {r["node"]: r["label"] for r in labels.collect()}
        best = plain_quality(rows, label, resolution)
        assert best >= plain_quality(rows, {v: 0 for v in label}, resolution) - 1e-12
        near = {}
        for a, b, _ in rows:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for v in label:
            for to in {label[u] for u in near[v]}:
                assert plain_quality(rows, label | {v: to}, resolution) <= best + 1e-9


def test_hashes_within_a_few_bits_hang_together(spark):
    rng = random.Random(8)
    rows, base = [], [rng.getrandbits(64) for _ in range(12)]
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7])):
            h ^= 1 << rng.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h))
    got = {r["id"]: r["group"] for r in graph.hash_groups(spark.createDataFrame(rows, "id long, h long"), "id", "h").collect()}
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, x), (j, y) in itertools.combinations(rows, 2):
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= 5 and group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    assert got == group


def test_audit_selections(spark):
    rows = [("f", "p1", "edge", 1), ("f", "p1", "medoid", 2), ("f", "p2", "other", 3), ("f", "p3", "edge", 4), ("f", "p4", "other", 5), ("g", "p1", "other", 6)]
    df = spark.createDataFrame(rows, "family string, parent string, role string, id int")
    got = audits.role_examples(df, "family", "parent", "role", "id", ["medoid", "edge"], 3).collect()
    assert sorted((r["family"], r["nth"], r["id"]) for r in got) == [("f", 1, 2), ("f", 2, 4), ("f", 3, 3), ("g", 1, 6)]
    held = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "photo string, family int")
    added = spark.createDataFrame([("a", 2), ("a", 9), ("b", 9)], "photo string, family int")
    assert sorted(map(tuple, audits.contributing(held, added, "photo", "family").select("photo", "family").collect())) == [("a", 2), ("b", 1), ("b", 3)]
    first = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "q int, is_visible boolean, is_correct boolean")
    top = spark.createDataFrame([(q, r) for q in (1, 2, 3) for r in (1, 2)], "q int, rank int")
    assert sorted(map(tuple, audits.recovered(first, top, "q").collect())) == [(1, 1), (1, 2)]
    families = spark.createDataFrame([("a", 2, 0.5), ("b", 2, 0.9), ("c", 3, None), ("d", 2, None), ("e", 2, 0.5)], "f string, parents int, sim double")
    order = lambda df: [r["f"] for r in df.orderBy("position").collect()]
    assert order(audits.family_order(families, "f", "parents", "sim")) == ["c", "b", "a", "e", "d"]
    ranking = spark.createDataFrame([("d", 1, 1), ("a", 2, 0), ("c", 3, 1)], "f string, position int, priority int")
    assert order(audits.family_order(families, "f", "parents", "sim", ranking)) == ["d", "c"]
    with pytest.raises(ValueError, match="does not have 3"):
        audits.audit_rows(top.withColumn("arm", F.lit("x")), "arm", "x", first, ["q"], expected=3)
    assert audits.audit_rows(top.withColumn("arm", F.lit("x")), "arm", "x", first, ["q"], expected=6).count() == 6
