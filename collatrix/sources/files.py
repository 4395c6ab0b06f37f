"""Readers of other formats: CSV with or without a mark, JSON lines, whole JSON documents, arrays, zip members."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from collatrix.operators.contracts import ContractError, expect
from collatrix.session import materialize

MARK = "﻿"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, columns taken by name and typed; what does not fit its type fails. Gzip is read alike."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text; a byte-order mark before the header is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix(MARK) for c in df.columns])


def read_wide_numbers(spark: SparkSession, path: str) -> DataFrame:
    """CSV of numbers and text in which empty and ``nan`` are missing."""
    df = read_csv_text(spark, path)
    return df.select(*[F.when(F.lower(F.trim(c)).isin("", "nan"), None).otherwise(F.col(c)).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str, wanted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """JSON lines, gzipped or not; with ``wanted``, only those keys, all of which must be there."""
    df = spark.read.schema(schema).json(path)
    if wanted is None:
        return df
    if wanted.select(key).join(df.select(key), key, "left_anti").limit(1).count():
        raise ContractError(f"a wanted {key} is missing in {path}")
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def read_document(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """A whole JSON document as one row; its ``schema_version`` must be as asked."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return expect(df, F.col("schema_version") == version, f"{path} is not of version {version}")


def read_verified(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """Binary files (path, content) whose SHA-256 is that in ``digests`` (name, sha256); others fail."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.substring_index("path", "/", -1).alias("name"))
    joined = files.join(digests, "name")
    return expect(joined, F.sha2("content", 256) == F.col("sha256"), "a file's digest differs from the manifest")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``.npy`` matrices as (file, row, v), one task per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                yield pd.DataFrame({"file": name, "row": np.arange(len(matrix)), "v": list(matrix)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, v array<float>")


def read_zip_manifest(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(archive, member, bytes, sha256) of the members under a prefix, one task per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [(name, m, len(data := z.read(m)), hashlib.sha256(data).hexdigest()) for m in sorted(z.namelist()) if m.startswith(prefix) and not m.endswith("/")]
                yield pd.DataFrame(members, columns=["archive", "member", "bytes", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, bytes long, sha256 string")


def read_zip_members(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(member, content) of the members that ``manifest`` (member, sha256) names; one that is missing or has another digest fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if not m.endswith("/"):
                            yield pd.DataFrame({"member": [m], "content": [z.read(m)]})

    held = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, content binary")
    joined = manifest.select("member", "sha256").join(held, "member", "left")
    return expect(joined, F.sha2("content", 256) == F.col("sha256"), "a member is missing or its digest differs from the manifest").select("member", "content")


def gather_rows(arrays: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``read_arrays`` at the positions in ``wanted`` (row, ...): an equality join, wherever the rows are."""
    return wanted.join(arrays.select("row", "v"), "row")


def read_jsonl_until(spark: SparkSession, paths: Sequence[str], schema: str, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The wanted rows of files that are read in turn, until all are found; later files are not opened."""
    missing, found = wanted.select(key).distinct(), None
    for path in paths:
        rows = spark.read.schema(schema).json(path).join(missing, key, "left_semi")
        found = rows if found is None else found.unionByName(rows)
        missing = materialize(missing.join(rows.select(key), key, "left_anti"), "missing")
        if missing.isEmpty():
            return found
    raise ContractError(f"a wanted {key} is in none of {len(paths)} files")


def text_schema(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])
