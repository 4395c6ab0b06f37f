"""What communities and components read is worked out once, and short cuts give what the long way gives."""

import numpy as np
import pytest

from collatrix.operators import graph, vectors


@pytest.mark.parametrize("of", [graph.communities, graph.sensitivity])
def test_edges_are_worked_out_once(spark, of):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0)], "a long, b long, weight double")
    found = of(edges.mapInPandas(count, edges.schema))
    assert found.count() and found.count()
    assert seen.value == 4


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(100, 140)]
    links = spark.createDataFrame([*rows, (None, 3)], "a long, b long")
    one = sorted(map(tuple, graph.connected_components(links).collect()))
    monkeypatch.setattr(graph, "ONE_TASK", -1)
    assert one == sorted(map(tuple, graph.connected_components(links).collect()))


def test_search_with_ties_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (150, 6)).astype(float)
    bank = spark.createDataFrame([(i, i % 7, i % 4, x[i].tolist()) for i in range(150)], "id long, parent long, family long, v array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["dst_parent"], r["dst_family"], r["sim"]) for r in vectors.search(bank, bank, 9, "parent").collect()}
    for q in range(150):
        order = sorted((i for i in range(150) if i % 7 != q % 7), key=lambda i: (-float(x[q] @ x[i]), i))
        assert [got[q, k] for k in range(1, 10)] == [(i, i % 7, i % 4, float(x[q] @ x[i])) for i in order[:9]]
    assert len(got) == 150 * 9
