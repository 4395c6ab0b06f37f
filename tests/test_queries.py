"""Every query with SQL gives what DuckDB gives; those without give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from collatrix.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: What must hold for every row of a query without SQL; their operators are held against plain versions in the other tests.
INVARIANTS = {
    "spanning_forest": [lambda r: r["a"] != r["b"] and r["weight"] > 0],
    "capped_extra_edges": [lambda r: r["a"] != r["b"] and r["weight"] > 0],
    "community_detection": [lambda r: r["label"] >= 0],
    "coverage_greedy_plan": [lambda r: r["gain"] > 0],
    "region_suppression": [lambda r: r["kept"] == (r["reason"] == "")],
    "review_sample": [lambda r: r["kind"] in ("core", "edge", "spread")],
    "partition_stability": [lambda r: -1 <= r["ari"] <= 1 + 1e-9],
    "bootstrap_auc": [lambda r: 0 <= r["low"] <= r["mean"] <= r["high"] <= 1],
    "paired_bootstrap_delta": [lambda r: r["low"] <= r["mean"] <= r["high"] and 0 <= r["above"] <= 1],
    "bootstrap_mean_ci": [lambda r: r["low"] <= r["mean"] <= r["high"]],
    "permutation_null": [lambda r: abs(r["cosine"]) <= 1],
    "random_negatives": [lambda r: r["key"] % 50 != r["partner"] % 50],
    "exemplar_roles": [lambda r: r["role"] in ("medoid", "hub", "smallest", "largest", "farthest", "weakest")],
    "grouped_cross_validation": [lambda r: 0 <= r["auc"] <= 1],
    "feature_pipeline": [lambda r: r["variance"] > 0],
    "create_session": [lambda r: r["is_pending"] == (r["position"] > 1)],
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, FOLDER)
    got = df.collect()
    if name not in registry.oracle_sql():
        assert got
        for found in INVARIANTS.get(name, ()):
            assert all(found(r) for r in got)
        return
    want = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
