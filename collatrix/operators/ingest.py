"""Ingest: exact duplicates by content, manifests, and best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.contracts import expect, expect_unique
from collatrix.operators.ranking import in_order


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group in a total order."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def duplicate_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """One row per content: its digest, the least key, the number of rows and all keys in order.

    Only digests and keys are shuffled, and combined before that; the list of a
    content that very many rows share is as long as that, so use ``canonical`` for mere mapping.
    """
    hashed = df.select(F.col(key).alias("key"), F.sha2(content, 256).alias("digest"))
    grouped = hashed.groupBy("digest").agg(F.min("key").alias("representative"), F.count("*").alias("members"), F.array_sort(F.collect_list("key")).alias("keys"))
    return grouped


def canonical(df: DataFrame, content: Column, key: str) -> DataFrame:
    """(key, canonical): the least key of the rows with the same content."""
    hashed = df.select(F.col(key).alias("key"), F.sha2(content, 256).alias("digest"))
    least = hashed.groupBy("digest").agg(F.min("key").alias("canonical"))
    return hashed.join(least, "digest").select("key", "canonical")


def content_key(digest: Column, key: Column) -> Column:
    """A trimmed, lower-cased digest of 64 characters names content; anything else is content of its own."""
    clean = F.lower(F.trim(digest))
    return F.when(F.length(clean) == 64, F.concat(F.lit("sha256:"), clean)).otherwise(F.concat(F.lit("photo:"), key.cast("string")))


def interleave(df: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """Round robin: the first row of each group, then the second of each, with their position."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return in_order(df.withColumn("turn", turn), ["turn", group], rank="position")


def shuffled(df: DataFrame, key: str, seeds: Sequence[int], rank: str = "rank") -> DataFrame:
    """(seed, key, rank): the rows in an order of their own for each seed, by a hash, the same in every run."""
    seeded = df.select(F.col(key), F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    mark = F.md5(F.concat_ws("-", "seed", key).cast("binary"))
    return seeded.withColumn(rank, F.row_number().over(W.partitionBy("seed").orderBy(mark, key)))


def priorities(df: DataFrame, key: str = "canonical_id", score: str = "score", keep: Sequence[str] = ()) -> DataFrame:
    """(key, score, rank, ``keep``) by score, then key; ids that repeat and scores that are not from 0 to 1 are errors.

    Only the named columns come out, so no label does.
    """
    expect_unique(df, [key], f"{key} repeats")
    fine = expect(df.select(key, score, *keep), ~F.isnan(score) & F.col(score).between(0, 1), f"{score} is not from 0 to 1")
    return in_order(fine, [F.desc(score), key], rank="rank")
