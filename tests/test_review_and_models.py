import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from collatrix.operators import evaluate, graph, groupstats, models
from collatrix.operators.contracts import ContractError
from collatrix.operators.review import ReviewSessions, policy_weight
from collatrix.sources import files, sinks

PHOTOS = {"a": [0, 1, 2], "b": [0, 3], "c": [1, 4], "d": [2], "e": [5]}


@pytest.fixture
def sessions(spark, tmp_path):
    rows = [(p, g) for p, gs in PHOTOS.items() for g in gs]
    return ReviewSessions(spark, str(tmp_path / "events"), spark.createDataFrame(rows, "item string, grp int"))


def test_session_flow(sessions, tmp_path):
    s = sessions.create(2)
    assert (s.version, s.batch, s.plan) == (1, 1, ["a", "b"])
    with pytest.raises(ContractError, match="not reviewed"):
        sessions.next_batch(s.session, 1)
    with pytest.raises(ContractError, match="not in the current"):
        sessions.review(s.session, 1, "e", "recorded")
    with pytest.raises(ValueError, match="outcome"):
        sessions.review(s.session, 1, "a", "odd")
    s = sessions.review(s.session, 1, "a", "excluded", "=1+1")
    with pytest.raises(ContractError, match="version"):
        sessions.review(s.session, 1, "b", "recorded")
    assert sessions.covered(s.session) == (0, 0)
    s = sessions.review(s.session, 2, "b", "uncertain", "x,\ny")
    s = sessions.review(s.session, 3, "b", "recorded")
    assert sessions.covered(s.session) == (2, 0)
    s = sessions.next_batch(s.session, 4)
    assert s.batch == 2
    assert "a" not in s.plan
    rows = sessions.export(s.session).collect()
    assert [(r["item"], r["outcome"]) for r in rows[:2]] == [("a", "excluded"), ("b", "recorded")]
    assert {r["outcome"] for r in rows[2:]} == {"pending"}
    sinks.write_marked_csv(sessions.export(s.session), str(tmp_path / "out"), ["position"])
    back = files.read_csv_text(sessions.spark, str(tmp_path / "out")).orderBy("position").collect()
    assert back[0]["note"] == "'=1+1"
    assert back[0]["groups"] == "0;1;2"
    with pytest.raises(KeyError):
        sessions.state("nobody")


def test_policy_weight(spark):
    df = spark.createDataFrame([(4, 0), (2, 2)], "c int, r int")
    assert [r[0] for r in df.select(policy_weight(F.col("c"), F.col("r"))).collect()] == [1.0, 0.25]
    with pytest.raises(Exception, match="0 to 4"):
        spark.createDataFrame([(5, 0)], "c int, r int").select(policy_weight(F.col("c"), F.col("r"))).collect()


def test_group_features(spark):
    df = spark.createDataFrame([("p", 1, 0.5), ("p", 1, 0.7), ("p", 2, -1.0), ("q", 1, 0.1)], "item string, grp int, strength double")
    got = {(r["item"], r["grp"]): r for r in models.group_features(df).collect()}
    total = np.log(3) + np.log(2)
    assert got["p", 1]["share"] == pytest.approx(np.log(3) / total)
    assert got["p", 1]["strength"] == 0.7
    assert got["p", 2]["strength"] == 0.0
    assert got["q", 1]["share"] == pytest.approx(np.log(2))


def test_cross_validation_and_pairs(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    rows = [(int(i), int(i // 3), float(y[i] + rng.normal()), float(rng.normal()), 1.0, int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, x double, z double, flat double, y int")
    stages = models.pipeline_stages(["x", "z", "flat"], 2)
    featured = Pipeline(stages=stages).fit(df).transform(df).select("g", "y", "features")
    ranked = models.cross_validate(featured, "y", "g", (0.0, 0.1), 3)
    assert ranked[0][1] > 0.7
    model = models.pair_classifier(df, ["x", "z"], "y")
    assert model.coefficients[0] > 0.5
    ci = models.bootstrap_mean(df, "x", "y", "id", 200).collect()
    means = {r["y"]: r["mean"] for r in ci}
    assert means == {k: pytest.approx(np.mean([r[2] for r in rows if r[5] == k])) for k in (0, 1)}
    weights = {r["id"]: w for r, w in zip(df.select("id", F.xxhash64("id").alias("h")).collect(), evaluate.draw_weights(np.array([r["h"] for r in df.select(F.xxhash64("id").alias("h")).collect()]), 200, 0), strict=True)}
    for r in ci:
        own = [x for x in rows if x[5] == r["y"]]
        w = np.stack([weights[x[0]] for x in own])
        plain = np.array([x[2] for x in own]) @ w / w.sum(axis=0)
        assert (r["low"], r["high"]) == (pytest.approx(np.quantile(plain, 0.025)), pytest.approx(np.quantile(plain, 0.975)))
    assert all(r["low"] <= r["mean"] <= r["high"] for r in ci)


def test_partners_are_of_another_group(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "id long, g int")
    got = models.random_partner(df, "id", "g").collect()
    assert len(got) == 200
    assert all(r["key"] % 4 != r["partner"] % 4 for r in got)
    ranked = spark.createDataFrame([(1, 0, 2, 0, 1), (1, 0, 3, 1, 2), (1, 0, 4, 1, 3), (1, 0, 5, 2, 4)], "src int, src_group int, dst int, dst_group int, rank int")
    assert sorted(r["dst"] for r in models.hard_negatives(ranked).collect()) == [3, 4]


def test_sensitivity_and_connectivity(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (2, 3, 0.1)], "a long, b long, weight double")
    grid = graph.sensitivity(edges, (0.5, 1.0), (1, 2))
    assert grid.count() == 6 * 4
    assert grid.groupBy("resolution", "seed").agg(F.countDistinct("label").alias("n")).where("n > 3").count() == 0
    labels = spark.createDataFrame([(0, 7), (5, 7), (1, 8), (2, 8)], "node long, label long")
    assert [tuple(r) for r in graph.disconnected_communities(edges, labels).collect()] == [(7, 2)]


def test_exemplars_and_samples(spark):
    rows = [("g", i, i % 7, float(i), float(10 - i), float(i * i), float(-i), i == 3) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, id int, parent int, degree double, size double, distance double, affinity double, is_medoid boolean")
    got = {r["role"]: r["id"] for r in groupstats.exemplars(df).collect()}
    assert got["medoid"] == 3
    assert got["hub"] == 19
    assert len(set(got.values())) == 6
    assert len({i % 7 for i in got.values()}) == 6
    picked = groupstats.core_and_edge(df, "grp", "degree", "id").collect()
    assert len(picked) <= 8
    assert {r["id"] for r in picked if r["kind"] == "core"} == {16, 17, 18, 19}
    assert {r["id"] for r in picked if r["kind"] == "edge"} == {0, 1, 2}


def test_permutation_null_equals_plain_regression(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(60)], "id long, x array<double>, y array<double>")
    train, test = df.where("id < 40"), df.where("id >= 40")
    null = models.permutation_null(train, test, "x", "y", "id", 1.0, draws=2, seed=3)
    for draw, got in enumerate(null):
        dealt = {r["id"]: r["y"] for r in models.permuted(train, "y", "id", 3 + draw).collect()}
        assert sorted(map(tuple, dealt.values())) == sorted(map(tuple, y[:40].tolist()))
        own = np.array([dealt[i] for i in range(40)])
        assert (own != y[:40]).any()
        w = evaluate.ridge(x[:40], own, 1.0)
        guess = x[40:] @ w[:-1] + w[-1]
        cosines = (guess * y[40:]).sum(axis=1) / (np.linalg.norm(guess, axis=1) * np.linalg.norm(y[40:], axis=1))
        assert got == pytest.approx(cosines.mean())
