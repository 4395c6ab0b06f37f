import pytest
from pyspark.sql import functions as F

from collatrix.operators import contracts as C


def test_expect_raises_on_a_bad_row_and_on_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert C.expect(df.where("x = 1"), F.col("x") > 0, "bad").count() == 1
    for bad in (df.where("x = 2"), df.where("x IS NULL")):
        with pytest.raises(Exception, match="too large"):
            C.expect(bad, F.col("x") < 2, "too large").collect()


def test_joins_check_their_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c")], "k int, y string")
    assert C.join_many_to_one(left, right, ["k"]).count() == 2
    with pytest.raises(C.ContractError):
        C.join_one_to_one(left, right, ["k"])
    with pytest.raises(C.ContractError):
        C.join_many_to_one(right, left, ["k"])
    more = spark.createDataFrame([(2, "z")], "k int, x string")
    with pytest.raises(Exception, match="no partner"):
        C.join_all_matched(left.unionByName(more), right, ["k"]).collect()


def test_key_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2, 2), (1, 2)))
    C.expect_same_keys(a, b, "k", "differ")
    with pytest.raises(C.ContractError):
        C.expect_same_keys(a, b.where("k = 1"), "k", "differ")


def test_written_intermediates_can_be_dropped(spark):
    import os

    from collatrix import session

    session.drop_materialized(spark)
    df = session.materialize(spark.range(3), "three")
    assert df.count() == 3
    place = session._WRITTEN[0].removeprefix("file:")
    assert os.path.isdir(place)
    assert session.drop_materialized(spark) == 1
    assert not os.path.isdir(place)


def test_golden_values_are_verified(spark):
    golden = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", float("nan")), ("d", None), ("e", 5.0)], "k string, v double")
    found = spark.createDataFrame([("a", 1.0 + 1e-13), ("b", 2.1), ("c", float("nan")), ("d", 1.0), ("f", 1.0)], "k string, v double")
    got = {r["k"]: r["verdict"] for r in C.reverify(golden, found, ["k"], "v", 1e-12).collect()}
    assert got == {"a": "same", "b": "differs", "c": "same", "d": "differs", "e": "missing", "f": "unexpected"}


def test_values_of_a_list_and_columns_by_prefix(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, "y", None)], "id int, kind string, score_a int")
    assert C.expect_one_of(df, "kind", ["x", "y"]).count() == 2
    for bad in ("x", "z"):
        with pytest.raises(Exception, match="kind is one of"):
            C.expect_one_of(df.unionByName(spark.createDataFrame([(3, None, 1)], df.schema)), "kind", [bad, "x"]).collect()
    assert sorted((r["id"], r["name"], r["value"]) for r in C.prefixed(df, ["id"], "score_").collect()) == [(1, "a", 2.0), (2, "a", None)]
    fresh = spark.createDataFrame([(1, 7), (2, 8)], "id int, score_a int")
    assert sorted(map(tuple, C.drop_and_replace(df, ["score_a"], fresh, ["id"]).collect())) == [(1, "x", 7), (2, "y", 8)]
