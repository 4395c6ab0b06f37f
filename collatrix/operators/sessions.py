"""Versioned review sessions and revisioned records as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.contracts import ContractError


def latest_revision(revisions: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the greatest revision of each key."""
    rest = [c for c in revisions.columns if c != key]
    best = revisions.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("x"))
    return best.select(key, "x.*")


def exact_revision(revisions: DataFrame, key: str, revision: str, wanted: int) -> DataFrame:
    return revisions.where(F.col(revision) == wanted)


def accepted(events: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """``events`` with ``is_accepted``: an update counts if it names the version its predecessor left.

    Versions grow by one with each accepted update, from 1; a stale update changes nothing.
    Each session is folded on its own, in the order of arrival.
    """
    names = events.columns

    def fold(pdf):
        pdf = pdf.sort_values(order)
        current, marks = 1, []
        for v in pdf[version]:
            marks.append(bool(v == current))
            current += marks[-1]
        return pdf.assign(is_accepted=marks)[[*names, "is_accepted"]]

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(key).applyInPandas(fold, f"{kind}, is_accepted boolean")


def last_outcomes(reviews: DataFrame, session: str, item: str, order: str) -> DataFrame:
    """The last review of each item in each session; earlier ones are overwritten."""
    ranked = reviews.withColumn("_n", F.row_number().over(W.partitionBy(session, item).orderBy(F.desc(order))))
    return ranked.where("_n = 1").drop("_n")


class RevisionStore:
    """Records (key, revision, parent, state) in a folder of Parquet files that only grow.

    One writer at a time; a revision is the last one plus one, and none is ever changed.
    """

    SCHEMA = "key string, revision int, parent int, state string"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def create(self, key: str, state: str) -> int:
        self.spark.createDataFrame([(key, 1, None, state)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return 1

    def revise(self, key: str, state: str, expected: int) -> int:
        """Append a revision; a stale ``expected`` is refused."""
        last = self.get(key)["revision"]
        if last != expected:
            raise ContractError(f"{key} is at revision {last}, not {expected}")
        self.spark.createDataFrame([(key, last + 1, last, state)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return last + 1

    def get(self, key: str, revision: int | None = None):
        rows = self._all().where(F.col("key") == key)
        rows = rows if revision is None else rows.where(F.col("revision") == revision)
        found = rows.orderBy(F.desc("revision")).limit(1).collect()
        if not found:
            raise KeyError(key)
        return found[0]

    def listing(self) -> DataFrame:
        """(key, revision, revisions, state) of all records, by key: the last revision, and how many there are."""
        counted = self._all().groupBy("key").agg(F.count("*").alias("revisions"))
        return self.latest().join(counted, "key").select("key", "revision", "revisions", "state").orderBy("key")

    def latest(self) -> DataFrame:
        return latest_revision(self._all(), "key", "revision").orderBy("key")
