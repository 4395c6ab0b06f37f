"""Readers and writers as queries: a table goes out in a format and comes back, and must be what it was."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.plans.registry import query
from collatrix.plans.vectors import items
from collatrix.session import fresh_path
from collatrix.sources import files, sinks
from collatrix.sources.tables import table


@query("json_document_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as one JSON document with a version, read whole and checked."""
    path = fresh_path(spark, "document")
    sinks.write_document(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_document(spark, path, "schema_version int, items array<struct<n_nationkey: int, n_name: string, n_regionkey: int>>").select(F.inline("items"))


@query("csv_typed_scan", "SELECT c_custkey, c_name, printf('%.2f', c_acctbal)::DOUBLE AS c_acctbal FROM customer")
def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV in a fixed order of fields with two decimals, read with types."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "c_acctbal"], decimals=2)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("csv_text_gz_scan", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def csv_text_gz_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped CSV, read as text."""
    path = fresh_path(spark, "csvgz")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name", "s_nationkey"], compression="gzip")
    return files.read_csv_text(spark, path)


@query("csv_marked_scan", "SELECT p_partkey::VARCHAR AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN chr(39) || '=' || p_name ELSE p_name END AS note, 'a;' || p_partkey AS tags FROM part")
def csv_marked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded CSV for spreadsheets with a byte-order mark, read as text without it."""
    path = fresh_path(spark, "marked")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("note"), F.array(F.lit("a"), F.col("p_partkey").cast("string")).alias("tags"))
    sinks.write_marked_csv(part, path, ["doc_id"])
    return files.read_csv_text(spark, path)


@query("jsonl_gz_round_trip", "SELECT event_id, user_id, event_type, props FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def jsonl_gz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped JSON lines, of which the wanted users' rows are read; all wanted users must be there."""
    path = fresh_path(spark, "jsonl")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    sinks.write_jsonl(events, path)
    wanted = events.where("event_type = 'click'").select("user_id").distinct()
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string, props string", wanted, "user_id")


@query("jsonl_early_stop", "SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderkey % 40 < 2")
def jsonl_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted rows of JSON lines in four files, read in turn until all are found: the last two are not opened."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    paths = []
    for k in range(4):
        paths.append(fresh_path(spark, f"lines{k}"))
        if k < 2:
            sinks.write_jsonl(orders.where(F.col("id") % 4 == k), paths[-1])
    wanted = orders.where("id % 4 IN (0, 1) AND id % 40 < 2").select("id")
    return files.read_jsonl_until(spark, paths, "id long, kind string", wanted)


@query("append_csv_round_trip", "SELECT 'region' AS kind, r_regionkey::VARCHAR AS key, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation")
def append_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two kinds in one CSV."""
    path = fresh_path(spark, "appended")
    kinds = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(f"{t[0]}_{t}key").alias("key"), F.col(f"{t[0]}_name").alias("name")) for t in ("region", "nation")]
    sinks.append_csv(*kinds, path)
    return files.read_csv_text(spark, path)


@query("npy_gather", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS dims FROM embeddings WHERE vec_id % 20 = 0")
def npy_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as array files, and the rows of every twentieth gathered by position."""
    folder = fresh_path(spark, "npy")
    bank = items(spark, sf_dir)
    sinks.save_files(sinks.npy_files(bank, "v", "id", rows_per_file=1_000_000), folder)
    from collatrix.operators.ranking import in_order

    places = in_order(bank.select("id"), ["id"], rank="n").where("id % 20 = 0").select("id", (F.col("n") - 1).alias("row"))
    found = files.gather_rows(files.read_arrays(spark, f"{folder}/part-000000.npy"), places)
    return found.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size("v").cast("long").alias("dims"))


def archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a zip archive for each language, of which documents are members."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                z.writestr(f"in/{i}.txt", text.encode())
            z.writestr("out/readme.txt", b"not a document")
        return pd.DataFrame({"name": [f"{pdf['part'].iloc[0]}.zip"], "content": [out.getvalue()]})

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 1000)).alias("part"))
    folder = fresh_path(spark, "zips")
    sinks.save_files(docs.groupBy("part").applyInPandas(pack, "name string, content binary"), folder)
    return folder


@query("zip_manifest", "SELECT 'in/' || doc_id || '.txt' AS member, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def zip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of the members of archives under a prefix."""
    return files.read_zip_manifest(spark, f"{archives(spark, sf_dir)}/*.zip", "in/").select("member", "bytes", "sha256")


@query("zip_members_verified", "SELECT 'in/' || doc_id || '.txt' AS member, length(coalesce(text, ''))::BIGINT AS chars FROM documents WHERE lang = 'de'")
def zip_members_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of archives that a manifest names, each with the digest that it says."""
    docs = table(spark, sf_dir, "documents").where("lang = 'de'")
    manifest = docs.select(F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("member"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    found = files.read_zip_members(spark, f"{archives(spark, sf_dir)}/*.zip", manifest)
    return found.select("member", F.length(F.col("content").cast("string")).cast("long").alias("chars"))


@query("dossier_csv_export", "SELECT n_nationkey::VARCHAR AS entry, n_name AS family, string_agg(s_suppkey::VARCHAR, ';' ORDER BY s_suppkey) AS photos FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def dossier_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their photos in one cell, exported for a spreadsheet and read back."""
    path = fresh_path(spark, "dossier")
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("entry")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("photos"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("family"))
    sinks.write_marked_csv(nation.join(held, "entry"), path, ["entry"])
    return files.read_csv_text(spark, path)


@query(
    "markdown_report",
    """WITH t AS (SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)
    SELECT '| p_partkey | p_name | p_retailprice |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
    string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || printf('%.3f', p_retailprice) || ' |', chr(10) ORDER BY p_retailprice DESC, p_partkey) AS report FROM t""",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest parts as a Markdown table."""
    best = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey")
    return spark.createDataFrame([(sinks.markdown(best, ["p_partkey", "p_name", "p_retailprice"], 20),)], "report string")


@query("written_receipt", "SELECT 1::BIGINT AS files, true AS digests_match")
def written_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of one written file against a digest of its bytes."""
    folder = fresh_path(spark, "receipt")
    body = b"region," + str(table(spark, sf_dir, "region").count()).encode()
    sinks.save_files(spark.createDataFrame([("part-0", bytearray(body))], "name string, content binary"), folder)
    return sinks.receipt(spark, folder).agg(F.count("*").alias("files"), F.bool_and(F.col("sha256") == hashlib.sha256(body).hexdigest()).alias("digests_match"))
