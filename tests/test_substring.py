"""Trigram searches find what a scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators import substring

TERMS = ["ring", "RING b", "r_ng", "ab%cd", "a", "", "%", "_", "zzzz", "b\\a", "éa", "aab", "b_%_a", " bab ", None, "\\\\", "100%"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abAB cdé\\%_") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["a Ring by 100%", "ring", "", None, "RiNG B"] * 2
    keys = [i if i % 3 else (i << 20) + i for i in range(len(texts))]
    return spark.createDataFrame([(k, x, "c") for k, x in zip(keys, texts, strict=True)], "id long, title string, gram string").repartition(3).cache()


def test_search_is_a_scan(spark, rows):
    terms = spark.createDataFrame(list(enumerate(TERMS)), "n int, term string")
    got = sorted(map(tuple, substring.search(substring.index(rows, "id", "title"), rows, "id", "title", terms, "n", "term").collect()))
    want = sorted((n, r["id"]) for n, x in enumerate(TERMS) if x is not None for r in rows.where(t.like_ascii_ci(F.col("title"), x)).collect())
    assert got == want and len(got) > 500
    assert substring.search(substring.index(rows.limit(0), "id", "title"), rows.limit(0), "id", "title", terms, "n", "term").count() == 0
    assert substring.search(substring.index(rows, "id", "title"), rows, "id", "title", terms.limit(0), "n", "term").count() == 0


def test_lists_are_sorted_in_bounded_blocks(spark, rows):
    postings = substring.index(rows, "id", "title")
    assert all(list(r["low"]) == sorted(set(r["low"])) and 0 <= r["low"][0] and r["low"][-1] < 1 << 16 for r in postings.collect())
    hits = {r["key"] for r in substring.candidates(postings, spark.createDataFrame([(1, "ring")], "n int, term string"), "n", "term").collect()}
    assert hits == {r["id"] for r in rows.where(F.lower("title").contains("rin") & F.lower("title").contains("ing")).collect()}
