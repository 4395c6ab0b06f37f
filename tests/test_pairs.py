"""Pairs inside families, in small blocks and ranges, against plain loops; the three queries make no row per pair in a join."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from collatrix.operators import pairs
from collatrix.plans import registry

FOLDER = "/root/testdata/sf0.001"
ITEMS = "id long, family long, context long, v array<double>"


@pytest.fixture
def bank(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    monkeypatch.setattr(pairs, "RANGE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, -(i % 3), rng.normal(size=64).tolist()) for i in range(70)]
    same = rng.normal(size=64).tolist()
    rows += [(i, 0, -(i % 3), same) for i in range(70, 100)]
    return [*rows, (100, 0, 0, None), (101, 5, 0, same), (102, None, 1, same)]


def plain(rows):
    half_up = lambda x: math.copysign(math.floor(abs(x) * 1e9 + 0.5) / 1e9, x)
    out = {}
    for (a, fa, ca, x), (b, fb, cb, y) in combinations(rows, 2):
        if fa is not None and fa == fb and ca != cb:
            cuts = ((0, 64), (0, 32), (32, 64))
            out[a, b] = (fa, [None if x is None or y is None else half_up(math.fsum(p * q for p, q in zip(x[s:e], y[s:e], strict=True))) for s, e in cuts])
    return out


def test_average_ranks_of_all_pairs(spark, bank):
    def make(src, dst, family, sims, ranks):
        return pd.DataFrame({"src": src, "dst": dst, "family": family, "r0": ranks[0], "r1": ranks[1], "r2": ranks[2]})

    got = pairs.ranked_pairs(spark.createDataFrame(bank, ITEMS), make, "src long, dst long, family long, r0 double, r1 double, r2 double").collect()
    want = plain(bank)
    assert len(got) == len(want) > 1500
    values = {f: [[math.inf if s[k] is None else s[k] for g, s in want.values() if g == f] for k in range(3)] for f in (0, 1)}
    for r in got:
        family, sims = want[r["src"], r["dst"]]
        assert r["family"] == family
        for k in range(3):
            own, all_ = math.inf if sims[k] is None else sims[k], np.array(values[family][k])
            average = (all_ < own).sum() + ((all_ == own).sum() + 1) / 2
            assert r[f"r{k}"] == average / len(all_)


def test_similarities_of_all_pairs(spark, bank):
    got = {(r["src"], r["dst"]): (r["family"], [r["sim"], r["first_half"], r["second_half"]]) for r in pairs.pair_sims(spark.createDataFrame(bank, ITEMS)).collect()}
    assert got == plain(bank)


def test_no_items(spark):
    assert pairs.pair_sims(spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("name", ["average_rank_pairs", "consensus_pair_selection", "pair_features"])
def test_no_row_per_pair_in_joins_and_windows(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "lambdafunction" not in plan
