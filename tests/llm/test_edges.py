"""Nulls, empty tables, repeated rows and clashing columns in every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stmtflow.llm import licenses, lsh_forest, mixing, mtree, rule_ensemble, suffix_dedup, tiling, toxicity, url_templates, warc

LONG = "word " * 60_000
PROSE = "some quiet words about the weather of the day and the sea that follow one another without any hurry at all"
ODD = [
    (1, PROSE, "en", "a", 3), (1, PROSE, "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, PROSE + " x", "en", "b", 1),
    (4, LONG, "de", "b", 300_000), (5, "Released under the MIT License.", "en", None, 5), (6, " \n\t ", "en", "a", 4), (None, None, None, None, None),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["_row", "block", "leaks", "size", "target", "copies", "_source", "_salt", "toxicity", "h", "_words", "_chars", "quality_score", "n_bytes", "copy", "component_id", "kept", "_text"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (77, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, odd, empty, labels):
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.toxicity < 0.5 for r in rows)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_quality(spark, odd, empty, labels):
    rows = rule_ensemble.score(odd, rule_ensemble.train(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 < r.quality_score < 1 for r in rows) and rows[0]._words == "_words"
    assert rule_ensemble.score(empty, rule_ensemble.train(empty, labels.limit(0))).count() == 0


def test_licences(odd, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD)
    assert [(r.n_base, r.first_word, r.labels) for r in rows if r.doc_id == 5] == [(1, 3, "mit")]
    assert all(r.score == 0 and r.labels == "" for r in rows if r.doc_id in (2, 3, 6))
    assert licenses.scan(empty).count() == 0


def test_repeats(odd, empty):
    rows = suffix_dedup.deduplicate(odd, keep=odd.columns, with_text=True).collect()
    assert len(rows) == len(ODD) and {r.block for r in rows} == {"block"} and {r._row for r in rows} == {"_row"}
    assert sorted(r.n_removed for r in rows if r.doc_id == 1) == [len(PROSE)] * 2
    assert [r.n_removed for r in rows if r.doc_id is None and r.text] == [0]
    assert [r.n_bytes for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_near_duplicates(odd, empty):
    rows = lsh_forest.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.component_id == r.doc_id and r.kept for r in rows)
    assert all(r.n_shingles == 0 for r in rows if r.doc_id in (2, 3, 6)) and [r.n_shingles for r in rows if r.doc_id == 4] == [1]
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_leaks(spark, odd, empty):
    bench = spark.createDataFrame([(0, PROSE), (0, PROSE), (None, None), (2, "")], "item_id bigint, text string")
    rows = tiling.find_leaks(odd, bench).collect()
    assert len(rows) == len(ODD) and all(len(r.leaks) == (2 if r.text and r.text.startswith("some quiet") else 0) for r in rows)
    kept = tiling.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3 and {r.leaks for r in kept.collect()} == {"leaks"}
    assert tiling.find_leaks(empty, bench).count() == 0 and tiling.decontaminate(odd, bench.limit(0)).count() == len(ODD)


def test_mix(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and {r._source for r in rows} == {"_source"}
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert mixing.emit(mixing.mix(empty)).count() == 0
    only = mixing.mix(empty.sparkSession.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


def test_mix_with_many_sources(odd, monkeypatch):
    few = mixing.mix(odd).select("doc_id", "size", "target", "taken").collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    many = mixing.mix(odd).select("doc_id", "size", "target", "taken").collect()
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a.org/" + "x/" * 3000, "p"), (3, "", ""), (4, "http://ünï.com/é", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(c) for c in ("host", "path", "_row", "_id", "salt")})
    judged = url_templates.judge(pages).collect()
    assert len(judged) == 5 and all(r.verdict in ("allow", "block") for r in judged)
    assert warc.archive_history(pages).count() == 5
    none = pages.limit(0)
    assert url_templates.judge(none).count() == 0 and warc.archive_history(none).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (21, []), (22, None), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "hash": F.lit(1), "block": F.lit(1)})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(x for x in got if x[0] == 20) == [(20, 1, 0, 2048), (20, 2, 0, 2048), (20, 3, 21, 0)]
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    flat = spark.createDataFrame([(0, []), (1, []), (20, [])], "vec_id bigint, embedding array<float>")
    assert mtree.top_k(flat, F.col("vec_id") % 20 == 0).count() == 4


def test_stages(spark, odd, empty, tmp_path):
    extra = {"documents": odd, "labels": spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")}
    extra["benchmark"] = spark.createDataFrame([(0, "nothing of this is anywhere at all")], "item_id bigint, text string")
    for name, df in extra.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in rows].count(1) <= 2 and all(r.block == "block" for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
