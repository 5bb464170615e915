"""The corpus pipeline, stage by stage, against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from offerlens.llm import secret_forest
from tests_llm_helpers import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages_return_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns
            assert after.exceptAll(before).count() == 0 or name == "secrets"


def test_quality_keeps_what_is_labelled_good(spark, sf, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id").count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * good
    bad = before.join(labels.where("quality = 0"), "doc_id").count()
    assert after.join(labels.where("quality = 0"), "doc_id").count() <= 0.2 * bad


def test_language_keeps_clean_texts(stages):
    before, after = stages["language"]
    assert after.count() >= 0.99 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {d for d, c in want.items() if d == c}


def test_secrets_are_replaced(stages):
    before, after = stages["secrets"]
    assert before.count() == after.count()
    hits = before.where(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).count()
    assert after.where(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).count() == 0
    assert after.where(F.col("text").contains(secret_forest.MARK)).count() >= hits
    assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count()


def test_packing_holds_all_that_is_left(stages):
    before, after = stages["packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_is_the_stages(spark, sf, stages):
    assert cp.run(spark, sf).count() == stages["packing"][1].count()


def test_odd_input(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean, _n long"
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate([None, "", "the and of it is there", "the and of it is there", "x"])]
    docs = spark.createDataFrame([*rows, rows[2], (None, "the and of it was here too", None, None, None, None, None, None)], schema)
    for name, stage in cp.STAGES:
        after = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name == "near_duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in after.select("doc_id").collect()) == [(False, 0), (False, 1), (False, 2), (False, 4), (True, None)]
        elif name == "secrets":
            assert after.count() == docs.count()


@pytest.mark.parametrize("few", [0, 500_000])
def test_rows_that_repeat_an_id(spark, sf, monkeypatch, few):
    """Unlike texts under one id stay both, copies of either go, and of equal rows one stays; with and without broadcast."""
    monkeypatch.setattr(cp.minhash_trees, "BROADCAST_IDS", few)
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a, "en", 1), (7, b, "en", 2), (7, b, "en", 2), (9, a + " end", "en", 3), (8, b, "de", 4), (3, "something else entirely here today", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = sorted((r["doc_id"], r["n_chars"]) for r in cp.near_duplicates(spark, docs, sf).collect())
    assert got == [(3, 5), (7, 1), (7, 2)]
