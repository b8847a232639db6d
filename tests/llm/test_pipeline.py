"""The corpus pipeline on a small table, each stage against what it must keep."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def test_stages(spark):
    from tidewatch.llm import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).persist()
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= before
        if name == "language_id":
            assert ids == {r["doc_id"] for r in kept.where("text rlike '[a-zA-Zéñäöü]'").select("doc_id").collect()}
        if name == "near_dedup":
            classes = near_dedup.near_duplicates(kept).collect()
            assert ids == {r["class_id"] for r in classes}
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the old house and the quiet garden", None, None, 9), (3, "the old house and the quiet garden", None, None, 9), (None, "the quiet garden and the old house", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = df
    for _, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, found, SF)
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["3", "None"]


def test_distinct_judges_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, c), (None, a), (4, c), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.distinct(spark, df, SF)
    assert found.columns == df.columns
    expected = [(1, a), (2, b), (3, c), (None, d), (None, c), (None, a), (5, None), (6, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found.collect()))) == sorted(map(str, expected))


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
