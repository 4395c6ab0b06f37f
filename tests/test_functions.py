import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.functions import geometry, scalar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("1.5", 1.5), ("nan", -1.0), ("inf", -1.0), ("", -1.0), (None, -1.0), ("-3", -3.0)])
def test_finite(spark, raw, want):
    assert one(spark, scalar.finite(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("=1+1", "'=1+1"), ("  -2", "'  -2"), ("a=b", "a=b"), ("@x", "'@x"), (None, None)])
def test_formula_guard(spark, raw, want):
    assert one(spark, scalar.formula_guard(F.lit(raw).cast("string"))) == want


def test_text_marks_and_folds(spark):
    assert one(spark, scalar.clean_text(F.lit("  "), "none")) == "none"
    assert one(spark, scalar.first_match(F.lit("A Blog"), [("blog", "b"), ("a", "a")], "x")) == "b"
    assert [one(spark, scalar.steps(F.lit(v), [(0.3, 1), (0.75, 4)])) for v in (0.1, 0.3, 0.75)] == [0, 1, 4]
    assert one(spark, scalar.fold(F.lit("0000000a" + "0" * 56))) == 0


def test_unit_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, scalar.unit(v)) == [0.6, 0.8]
    assert math.isclose(one(spark, scalar.dot(v, v)), 25.0)
    assert one(spark, scalar.unit(F.array(F.lit(0.0)))) == [0.0]


def test_masks_round_trip():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (40, 33)):
        mask = (rng.random((h, w)) < 0.3).astype(np.uint8)
        assert (geometry.decode_mask(geometry.encode_mask(mask), h, w) == mask).all()
        assert len(geometry.mask_digest(mask)) == 64
    with pytest.raises(ValueError, match="fill"):
        geometry.decode_mask(geometry.encode_mask(np.ones((2, 2))), 3, 3)


def test_mask_area_and_boxes(spark):
    mask = np.zeros((4, 6), dtype=np.uint8)
    mask[1:3, 2:5] = 1
    df = spark.createDataFrame([(geometry.encode_mask(mask),)], "m string")
    assert df.select(geometry.mask_area("m").alias("n")).first()["n"] == 6
    assert [one(spark, c) for c in geometry.centered_box(F.lit(90), F.lit(50), 32)] == [29, 9, 61, 41]
    levels = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    cells = [tuple(r) for r in levels.select(F.inline(geometry.prompt_grid(F.col("n")))).collect()]
    assert len(cells) == 21 and cells[0] == (0.0, 0.0, 1.0, 1.0)
    assert cells[1] == (0.0, 0.0, 0.5625, 0.5625) and cells[-1] == (0.71875, 0.71875, 1.0, 1.0)
    assert geometry.decode_mask(geometry.encode_mask(np.ones((2, 3))), 2, 3).all()
    assert geometry.run_lengths(geometry.encode_mask(np.ones((2, 3)))).tolist() == [0, 6]
    assert geometry.decode_mask(geometry.encode_mask(np.zeros((0, 4))), 0, 4).shape == (0, 4)
