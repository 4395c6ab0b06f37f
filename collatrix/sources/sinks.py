"""Writers: CSV in a fixed order and with guarded text, JSON lines, Markdown tables, digests of what was written."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.functions.scalar import formula_guard
from collatrix.operators.ranking import in_order
from collatrix.sources.files import MARK


def write_csv(df: DataFrame, path: str, columns: Sequence[str], decimals: int | None = None, compression: str = "none") -> None:
    """CSV with a header and columns in the given order; doubles with a fixed number of decimals."""
    kinds = dict(df.dtypes)
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if decimals is not None and kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def guarded(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run is quoted; lists are joined by semicolons."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out.append(formula_guard(F.array_join(F.col(name).cast("array<string>"), ";")).alias(name))
        elif kind == "string":
            out.append(formula_guard(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_marked_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One CSV file for spreadsheets: guarded, in order, its header after a byte-order mark.

    For exports that a person opens; the rows are sorted into a single file.
    """
    safe = guarded(df)
    first = safe.columns[0]
    rows = safe.orderBy(*order).coalesce(1).withColumnRenamed(first, MARK + first)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def append_csv(df: DataFrame, more: DataFrame, path: str) -> None:
    """Two kinds of rows with the same columns in one CSV."""
    df.unionByName(more).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, columns: Sequence[str], most: int = 20) -> str:
    """The first rows as a Markdown table; ``df`` must be ordered."""
    rows = df.select(*columns).limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)


def label(value, names: dict[str, str]):
    """A label for a code: its name, or the code with spaces for underscores."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, value), F.replace(value, F.lit("_"), F.lit(" ")))


def receipt(spark, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files that a writer left under a path, markers and checksums aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_document(df: DataFrame, path: str, version: int = 1) -> None:
    """All rows as the items of one JSON document with a version; the committer makes it appear at once.

    A document is one file, so one task writes it, row by row: nothing is gathered.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        yield pd.DataFrame({"value": [f'{{"schema_version":{version},"items":[']})
        for batch in batches:
            for at in batch["value"]:
                yield pd.DataFrame({"value": [at if first else "," + at]})
                first = False
        yield pd.DataFrame({"value": ["]}"]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
    rows.mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def npy_files(df: DataFrame, column: str, order: str, rows_per_file: int = 100_000) -> DataFrame:
    """(name, content) of ``.npy`` matrices of the vectors in ``column``, in order, so many rows a file; names sort like the rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack(pdf.sort_values("_n")["_v"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"name": [f"part-{int(pdf['_file'].iloc[0]):06d}.npy"], "content": [out.getvalue()]})

    numbered = in_order(df.select(F.col(column).alias("_v"), F.col(order).alias("_o")), ["_o"], rank="_n")
    dealt = numbered.select("_v", "_n", F.floor((F.col("_n") - 1) / rows_per_file).alias("_file"))
    return dealt.groupBy("_file").applyInPandas(pack, "name string, content binary")


def save_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) as files of a folder, on whatever file system it is; one file at a time passes through the driver."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in files.select("name", "content").toLocalIterator():
        place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
        out = place.getFileSystem(conf).create(place, True)
        out.write(bytes(r["content"]))
        out.close()
