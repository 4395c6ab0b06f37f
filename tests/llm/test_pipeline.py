import os

import pytest

import corpus_pipeline
from collatrix.llm import quality
from collatrix.llm.store import documents, read
from tests.llm.brute import hits, near_classes, repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_stages_equal_plain_ones(spark):
    docs = documents(spark, FOLDER).select("*").where("doc_id < 120")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    good = stages["quality_rules"](spark, docs, FOLDER)
    judged = quality.judge(docs, read(spark, FOLDER, "labels")).where("kept").collect()
    assert good.columns == columns
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert sorted(texts) == sorted(r["doc_id"] for r in judged)
    one = stages["near_dedup"](spark, good, FOLDER)
    assert one.columns == columns
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert sorted(kept) == sorted(set(near_classes(list(texts.items())).values()))
    cut = stages["repeated_passages"](spark, one, FOLDER)
    assert cut.columns == columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    plain = {k: v[4].decode("utf-8", "ignore") for k, v in repeats(list(kept.items())).items()}
    assert left == {k: t for k, t in plain.items() if t}
    clean = stages["benchmark_decontamination"](spark, cut, FOLDER)
    assert clean.columns == columns
    items = [(r["item_id"], r["text"]) for r in read(spark, FOLDER, "benchmark").collect()]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, t in left.items() if not hits(t, items)[1])
    mixed = stages["source_mixing"](spark, clean, FOLDER).collect()
    assert {r["doc_id"] for r in mixed} <= set(left)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_run_gives_the_mix(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "text", "lang", "source", "n_chars", "mix_pass", "mix_time"} == set(found.columns)
    assert found.count() > 0


def test_stages_take_odd_rows(spark):
    rows = [(None, "w " * 60, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " ".join(f"t{i}" for i in range(90)), "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            assert set(docs.columns) <= set(stage(spark, df, FOLDER).columns)
            stage(spark, df, FOLDER).collect()
