"""The corpus pipeline on the smallest tables, and stage by stage on planted cases."""

import corpus_pipeline
from pyspark.sql import functions as F

from lakescreen.llm import decontam, toxicity
from tests.llm.test_corpus import brute_classes

SF = "/root/testdata/sf0.001"


def test_run_keeps_and_mixes(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) <= set(out.columns)
    rows = out.select("doc_id", "copy", "source", "size", "target").collect()
    assert rows and len({(r.doc_id, r.copy) for r in rows}) == len(rows) and max(r.copy for r in rows) <= 2
    taken = {}
    for r in rows:
        taken.setdefault(r.source, [0, r.target, 0])
        taken[r.source][0] += r.size
        taken[r.source][2] = max(taken[r.source][2], r.size)
    assert all(abs(t - goal) <= most + 6000 for t, goal, most in taken.values())


def test_filters_keep_columns_and_null_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, text), (2, text), (3, text + " tail"), (4, None), (None, "alone"), (5, "before " + item + " after"), (6, "call +1 202 555 0177 now")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_leaks(spark, kept, SF).collect()) == [0, 1, 4, 6]
    assert corpus_pipeline.mask_personal_data(spark, docs, SF).where(F.col("doc_id") == 6).first().text == "call <PHONE> now"
    assert len(corpus_pipeline.STAGES) == 5


def test_repeated_ids_and_clashing_names(spark):
    """Two texts under one doc_id are two documents; columns that the stages use for themselves come back as they were."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0.5, "a"), (1, "another text of few words", 0.6, "b"), (2, text, 0.7, "c"), (2, text, 0.7, "c"), (None, "x", 0.8, "d"), (None, "x", 0.8, "d"), (None, None, 0.9, "e")]
    docs = spark.createDataFrame([(*r, "en", f"s{r[0]}", 1, "k", "t", 3, 4, 5) for r in rows], "doc_id long, text string, score double, _row string, lang string, source string, n_chars long, key string, _text string, copies int, copy int, size long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r._row, r.score) for r in kept.collect())
    assert got == [(0, "", "e", 0.9), (0, "x", "d", 0.8), (1, "another text of few words", "b", 0.6), (1, text, "a", 0.5)]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_leaks, corpus_pipeline.mask_personal_data):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(r._row for r in out.collect()) == sorted(r[3] for r in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "size_", "target", "copy_"] or set(mixed.columns) == {*docs.columns, "size_", "target", "copy_"}
    assert all(r.size == 5 and r.copies == 3 and r.copy == 4 and r.size_ == len(r.text.split()) for r in mixed.collect())


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_filters_against_brute_force(spark):
    """Each filter's rows on the smallest tables: toxic by the operator's scores, one head a class by all pairs, leaks by aligned pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = brute_classes(rows)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, t in rows if root[i] == i}
    found = decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()} == {i for i, _ in rows} - {r.doc_id for r in found.collect()}
    scores = toxicity.score(docs, toxicity.teach(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == {r.doc_id for r in scores.collect() if r.score < 0.4}
