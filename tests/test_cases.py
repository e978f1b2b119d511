"""Labelled cases and corpora that are read and checked, and distances that don't exist."""

import json

import pytest

from loomdoc.operators import evaluation, search


def test_cases_are_read(spark, tmp_path):
    cases = [{"question": " Why so? ", "expected_source": "7", "expected_source_field": "article_id", "filters": {"source_file": "a.pdf"}}, {"question": "None?", "expect_no_context": True}]
    (tmp_path / "list.json").write_text(json.dumps(cases))
    (tmp_path / "object.json").write_text(json.dumps({"cases": cases, "name": "x"}))
    (tmp_path / "bare.json").write_text(json.dumps([{"question": "Only"}]))
    want = [("None?", None, None, True, None), ("Why so?", "7", "article_id", False, {"source_file": "a.pdf"})]
    for name in ("list.json", "object.json"):
        assert sorted((tuple(r) for r in evaluation.read_cases(spark, str(tmp_path / name)).collect()), key=str) == want
    assert [tuple(r) for r in evaluation.read_cases(spark, str(tmp_path / "bare.json")).collect()] == [("Only", None, None, False, None)]


def test_broken_chunks_of_a_corpus(spark):
    rows = [("a", "1", "f", "u", "text"), ("b", " ", "f", None, "text"), ("c", "1", "f", "u", "t"), ("c", "2", "f", "u", "t"), (None, "1", "f", "u", "x")]
    corpus = spark.createDataFrame(rows, "id string, article_id string, source_file string, source_url string, text string")
    got = sorted((tuple(r) for r in evaluation.validated_corpus(corpus).collect()), key=str)
    assert got == [("b", "article_id,source_url", False), ("c", "", True), ("c", "", True), (None, "id", False)]
    assert evaluation.validated_corpus(corpus.limit(0)).count() == 0


def test_rules_of_a_case_set():
    good = [{"question": f"q{i}", "expected_source": "x"} for i in range(evaluation.MIN_CASES)] + [{"question": "n", "expect_no_context": True}] * evaluation.MIN_NO_CONTEXT
    assert evaluation.validated_cases(good)[0]["question"] == "q0"
    for bad in ({"question": " "}, {"question": "q", "expect_no_context": "no"}, {"question": "q"}, {"question": "q", "expected_source": "x", "filters": {"colour": "red"}}):
        with pytest.raises(ValueError):
            evaluation.validated_cases([*good, bad])
    with pytest.raises(ValueError):
        evaluation.validated_cases(good[:1])


def test_chunks_without_a_vector_come_last(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [])], "vec_id int, embedding array<double>")
    queries = chunks.where("vec_id <= 2")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in search.top_k_batch(queries, chunks, 4).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 2.0), (1, 3, 3, None), (1, 4, 4, None), (2, 1, 2, 0.0), (2, 2, 1, 2.0), (2, 3, 3, None), (2, 4, 4, None)]
    assert search.top_k_batch(queries, chunks, 2).where("distance is null").count() == 0
    alone = [(r["vec_id"], r["distance"]) for r in search.top_k(chunks, [1.0, 0.0], 4, threshold=0.5, key="vec_id").collect()]
    assert alone == [(1, 0.0), (3, None), (4, None)]
