"""Region queries: a line of an order is a region of a photo, its box made from quantity and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.functions.geometry import area, centered_box, edge_touches, padded_box, prompt_grid
from collatrix.functions.scalar import failed_reasons
from collatrix.operators.regions import holders, suppress
from collatrix.plans.registry import query
from collatrix.sources.tables import table


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo, region, score, x0, y0, x1, y1, width, height)."""
    line = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return line.select(
        F.col("l_orderkey").alias("photo"),
        F.col("l_linenumber").cast("long").alias("region"),
        F.col("l_discount").cast("double").alias("score"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 5 + F.col("l_quantity").cast("double")).alias("x1"),
        (y0 + 5 + F.col("l_partkey") % 35).alias("y1"),
        F.lit(110.0).alias("width"),
        F.lit(80.0).alias("height"),
    )


BOX_SQL = """reg AS (SELECT l_orderkey AS photo, l_linenumber::BIGINT AS region, l_discount::DOUBLE AS score, (l_partkey % 60)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS y0,
    (l_partkey % 60)::DOUBLE + 5 + l_quantity::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE + 5 + l_partkey % 35 AS y1 FROM lineitem)"""


@query(
    "region_qc_reasons",
    f"""WITH {BOX_SQL}, m AS (SELECT photo, region, (x1 - x0) * (y1 - y0) / 8800.0::DOUBLE AS fraction, least(x1 - x0, y1 - y0) AS side,
        (x0 <= 1.5)::INT + (y0 <= 1.5)::INT + (x1 >= 108.5)::INT + (y1 >= 78.5)::INT AS touches FROM reg)
    SELECT photo, region, array_to_string(list_filter([CASE WHEN fraction < 0.02 THEN 'small' END, CASE WHEN fraction > 0.2 THEN 'large' END,
        CASE WHEN side < 8 THEN 'thin' END, CASE WHEN touches > 0 THEN 'edge' END], lambda x: x IS NOT NULL), ';') AS reasons FROM m""",
)
def region_qc_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric rules that regions fail."""
    r = regions(spark, sf_dir)
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    fraction, side = area(*c) / (F.col("width") * F.col("height")), F.least(c[2] - c[0], c[3] - c[1])
    rules = [("small", fraction < 0.02), ("large", fraction > 0.2), ("thin", side < 8), ("edge", edge_touches(*c, F.col("width"), F.col("height")) > 0)]
    return r.select("photo", "region", failed_reasons(rules).alias("reasons"))


@query(
    "crop_boxes",
    f"""WITH {BOX_SQL} SELECT photo, region, greatest(floor(x0 - (x1 - x0) * 0.1::DOUBLE), 0)::BIGINT AS cx0, greatest(floor(y0 - (y1 - y0) * 0.1::DOUBLE), 0)::BIGINT AS cy0,
    least(ceil(x1 + (x1 - x0) * 0.1::DOUBLE), 110)::BIGINT AS cx1, least(ceil(y1 + (y1 - y0) * 0.1::DOUBLE), 80)::BIGINT AS cy1, 39 AS mx0, 24 AS my0, 71 AS mx1, 56 AS my1 FROM reg""",
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes with a margin, and the middle square of each image."""
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    padded = padded_box(*c, F.col("width"), F.col("height"))
    middle = centered_box(F.col("width"), F.col("height"), 32)
    names = ("x0", "y0", "x1", "y1")
    return regions(spark, sf_dir).select(
        "photo", "region", *[p.cast("long").alias(f"c{n}") for p, n in zip(padded, names, strict=True)], *[p.cast("int").alias(f"m{n}") for p, n in zip(middle, names, strict=True)]
    )


@query(
    "region_holders",
    f"""WITH {BOX_SQL}, s AS (SELECT *, (x1 - x0) * (y1 - y0) AS size FROM reg),
    p AS (SELECT a.photo, a.region, b.region AS holder, b.size, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS common, a.size AS own
        FROM s a JOIN s b ON a.photo = b.photo AND a.region <> b.region AND b.size > a.size)
    SELECT photo, region, holder FROM p WHERE common >= 0.9::DOUBLE * own AND own <= 0.8::DOUBLE * size QUALIFY row_number() OVER (PARTITION BY photo, region ORDER BY size, holder) = 1""",
)
def region_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest larger region that holds each region."""
    return holders(regions(spark, sf_dir))


@query("region_suppression")
def region_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that stay when overlapping ones are suppressed, the best score first."""
    return suppress(regions(spark, sf_dir), iou=0.5, inside=0.8, ratio=0.5)


@query(
    "prompt_boxes",
    """WITH g AS (SELECT n, i, j FROM (SELECT unnest([1, 2, 4]) AS n), LATERAL (SELECT unnest(range(n)) AS i), LATERAL (SELECT unnest(range(n)) AS j)),
    p AS (SELECT *, CASE WHEN n > 1 THEN 0.125::DOUBLE / n ELSE 0 END AS pad FROM g)
    SELECT n::BIGINT AS level, greatest(0, i / n::DOUBLE - pad) AS x0, greatest(0, j / n::DOUBLE - pad) AS y0, least(1, (i + 1) / n::DOUBLE + pad) AS x1, least(1, (j + 1) / n::DOUBLE + pad) AS y1 FROM p""",
)
def prompt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one, four and sixteen cells."""
    levels = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    return levels.select(F.col("n").cast("long").alias("level"), F.inline(prompt_grid(F.col("n"))))
