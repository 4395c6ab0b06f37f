from pyspark.sql import functions as F

from collatrix.llm.store import count_words, first_by_hash


def test_first_by_hash_is_the_plain_order(spark):
    df = spark.range(5000).repartition(6)
    want = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r["id"] for r in first_by_hash(df, "id", 300).collect()] == want
    assert first_by_hash(df, "id", 9000).count() == 5000
    assert first_by_hash(df.limit(0), "id", 9).count() == 0


def test_words(spark):
    texts = [None, "", " ", "a", " a", "a ", "\n a\tb\r\n", "a b c", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(count_words(F.col("t"))).collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 1]
