"""Each stage of the pipeline against brute force on its own input, and on edge cases."""

import pandas as pd

import corpus_pipeline as cp
from tidewire.llm import decontamination, quality_rules
from tidewire.llm.common import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES:
        given = docs.toPandas()
        docs = staged(stage(spark, docs, sf), "stage")
        out = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns and set(out.doc_id) <= set(given.doc_id) and 0 < len(out) <= before
        if name == "quality_rules":
            judged = {k: quality_rules.judge(t, 40) for k, t in zip(given.doc_id, given.text)}
            assert {k: t for k, t in zip(out.doc_id, out.text)} == {k: j[-1] for k, j in judged.items() if j[6]}
        if name == "near_dedup":
            from test_operators import slow_similar

            given = given.sort_values("doc_id")
            assert sorted(out.doc_id) == sorted(given.doc_id.iloc[sorted(set(slow_similar(given.text)))])
        if name == "decontamination":
            hits = decontamination.contamination(spark.createDataFrame(given), spark.read.parquet(sf + "/benchmark.parquet")).toPandas()
            assert set(out.doc_id) == set(hits[hits.n_hit == 0].doc_id)
        if name == "packing":
            assert set(out.doc_id) == set(given.doc_id) and out.groupby("doc_id").length.sum().equals(out.groupby("doc_id").doc_tokens.max().rename("length"))


def test_edge(spark, sf, edge, empty):
    for docs in (edge, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count() or name == "packing"
            assert name == "packing" or out.columns == docs.columns


def test_clean_labelled_documents_stay(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(d + "/documents.parquet")
    kept = cp.quality_rules_stage(spark, cp.quality_classifier_stage(spark, docs, d), d).toPandas()
    labels = pd.read_parquet(d + "/labels.parquet")
    long = docs.toPandas().set_index("doc_id").text.str.split().str.len()
    clean = labels[(labels.quality == 1) & (labels.doc_id.map(long) >= 20)].doc_id
    assert clean.isin(kept.doc_id).mean() > 0.97 and labels[labels.quality == 0].doc_id.isin(kept.doc_id).mean() < 0.05


def test_equal_and_null_ids_are_judged_row_by_row(spark, sf):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    passage = pd.read_parquet(sf + "/benchmark.parquet").text[0]
    own = [(3, words(0)), (5, words(0)), (5, words(1)), (None, words(2)), (None, words(0)), (7, words(3)), (7, words(4)), (7, words(4)), (None, words(5)), (None, words(5))]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    kept = cp.near_dedup_stage(spark, docs, sf)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(3, words(0)), (5, words(1)), (7, words(3)), (7, words(4)), (None, words(2)), (None, words(5))]
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)
    dirty = [(5, passage), (None, passage)]
    clean = cp.decontamination_stage(spark, spark.createDataFrame(want + dirty, docs.schema), sf)
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(want, key=key)
