import gzip
import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.operators.contracts import ContractError
from collatrix.sources import files, sinks


def test_csv_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\nx,1\n".encode())
    assert [tuple(r) for r in files.read_csv_text(spark, str(tmp_path / "a.csv")).collect()] == [("x", "1")]
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"name,n\ny,2.5\nz,\n"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv.gz"), "name string, n double").collect()] == [("y", 2.5), ("z", None)]
    (tmp_path / "c.csv").write_text("a,b\nnan,1\n,2\n")
    assert [tuple(r) for r in files.read_wide_numbers(spark, str(tmp_path / "c.csv")).collect()] == [(None, "1"), (None, "2")]


def test_jsonl_semi_join(spark, tmp_path):
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress("\n".join(json.dumps({"id": i, "v": [i]}) for i in range(5)).encode()))
    wanted = spark.createDataFrame([(1,), (3,)], "id long")
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "id long, v array<int>", wanted)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]
    with pytest.raises(ContractError):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "id long, v array<int>", spark.createDataFrame([(9,)], "id long"))


def test_document_version(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 2, "items": [1]}, indent=1))
    assert files.read_document(spark, str(tmp_path / "d.json"), "schema_version int, items array<int>", 2).first()["items"] == [1]
    with pytest.raises(Exception, match="not of version"):
        files.read_document(spark, str(tmp_path / "d.json"), "schema_version int, items array<int>").collect()


def test_arrays_and_zips(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert [r["v"] for r in files.read_arrays(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in/a.txt", b"a")
        z.writestr("out/b.txt", b"b")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    got = files.read_zip_manifest(spark, str(tmp_path / "z.zip"), "in/").collect()
    assert [(r["member"], r["bytes"]) for r in got] == [("in/a.txt", 1)]


def test_verified_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = spark.createDataFrame([("x.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")], "name string, sha256 string")
    assert files.read_verified(spark, str(tmp_path / "x.bin"), good).count() == 1
    with pytest.raises(Exception, match="digest differs"):
        files.read_verified(spark, str(tmp_path / "x.bin"), spark.createDataFrame([("x.bin", "0")], "name string, sha256 string")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", ["a", "b"], 0.5), (2, 'x,"y"\nz', [], 2.0)], "n int, note string, ids array<string>, s double")
    sinks.write_marked_csv(df, str(tmp_path / "m"), ["n"])
    text = next((tmp_path / "m").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfn,")
    back = files.read_csv_text(spark, str(tmp_path / "m")).collect()
    assert [r["note"] for r in back] == ["'=1+1", 'x,"y"\nz']
    assert back[0]["ids"] == "a;b"
    sinks.write_csv(df, str(tmp_path / "c"), ["s", "n"], decimals=3)
    assert sorted(r["s"] for r in files.read_csv_text(spark, str(tmp_path / "c")).collect()) == ["0.500", "2.000"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "n int, note string").count() == 2
    assert sinks.markdown(df.orderBy("n"), ["n", "s"]).splitlines()[2] == "| 1 | 0.500 |"


def test_documents_and_receipts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    sinks.write_document(df, str(tmp_path / "d"), 3)
    back = files.read_document(spark, str(tmp_path / "d"), "schema_version int, items array<struct<n: int, s: string>>", 3).first()
    assert sorted(i["s"] for i in back["items"]) == ["a", "b"]
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "s"])
    rows = sinks.receipt(spark, str(tmp_path / "c")).collect()
    assert sum(r["bytes"] for r in rows) == sum(p.stat().st_size for p in (tmp_path / "c").glob("part-*"))
    assert all(len(r["sha256"]) == 64 for r in rows)


def test_jsonl_in_turn_until_all_are_found(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_text("\n".join(json.dumps({"id": 10 * n + i, "v": i}) for i in range(4)))
    paths = [str(tmp_path / f"{n}.jsonl") for n in range(3)] + ["/no/such/file"]
    wanted = spark.createDataFrame([(2,), (11,)], "id long")
    assert sorted(r["id"] for r in files.read_jsonl_until(spark, paths, "id long, v int", wanted).collect()) == [2, 11]
    with pytest.raises(ContractError):
        files.read_jsonl_until(spark, paths[:3], "id long, v int", spark.createDataFrame([(99,)], "id long"))


def test_zip_members_by_manifest(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", b"a")
        z.writestr("b.txt", b"b")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    read = lambda rows: files.read_zip_members(spark, str(tmp_path / "z.zip"), spark.createDataFrame(rows, "member string, sha256 string")).collect()
    assert [(r["member"], bytes(r["content"])) for r in read([("b.txt", digest(b"b"))])] == [("b.txt", b"b")]
    for bad in ([("b.txt", digest(b"a"))], [("c.txt", digest(b"b"))]):
        with pytest.raises(Exception, match="missing or its digest"):
            read(bad)


def test_documents_and_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f"n\"{i}\n") for i in range(50)], "id long, name string").repartition(4)
    for rows in (df, df.limit(0)):
        sinks.write_document(rows, str(tmp_path / "doc"), version=3)
        found = files.read_document(spark, str(tmp_path / "doc"), "schema_version int, items array<struct<id: long, name: string>>", 3)
        assert sorted(map(str, found.select(F.inline("items")).collect())) == sorted(map(str, rows.collect()))
    bank = spark.createDataFrame([(100 - i, [float(i), 0.5]) for i in range(25)], "id long, v array<double>").repartition(3)
    sinks.save_files(sinks.npy_files(bank, "v", "id", rows_per_file=10), str(tmp_path / "npy"))
    names = sorted(p.name for p in (tmp_path / "npy").glob("*.npy"))
    assert names == ["part-000000.npy", "part-000001.npy", "part-000002.npy"]
    assert np.concatenate([np.load(tmp_path / "npy" / n) for n in names])[:, 0].tolist() == [float(i) for i in range(24, -1, -1)]
    got = files.gather_rows(files.read_arrays(spark, str(tmp_path / "npy" / names[0])), spark.createDataFrame([(3,), (5,)], "row long"))
    assert {r["row"]: r["v"] for r in got.collect()} == {3: [21.0, 0.5], 5: [19.0, 0.5]}
