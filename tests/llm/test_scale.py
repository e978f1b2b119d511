"""What only shows at scale: hostile pages, retried tasks, many sources, folders of other file systems, repeated rows."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import common, html, mixing, tokenfile
from loomdoc.llm.tokens import vocabulary_file

HOSTILE = ['<a "', "<a ", '<a ">" ', "<!", "<!-- ", "</p ", '<a "\'>', "<script", "<", "&"]


def seconds(page):
    began = time.process_time()
    html.main_text(page, html.start_weights())
    return time.process_time() - began


@pytest.mark.parametrize("unit", HOSTILE)
def test_pages_are_read_in_linear_time(unit):
    """Four times the length takes four times as long, not sixteen times."""
    seconds(unit * 1000)
    short, long = (min(seconds(unit * n) for _ in range(2)) for n in (20_000, 80_000))
    assert long < 9 * short + 0.1, (unit, short, long)


def test_elements_that_never_close():
    page = "<div class=ad>" * 20_000 + "</p>" * 20_000
    assert seconds(page) < 5


def test_the_mark_is_no_feature(spark):
    """Pages without the mark that others have give the same text; copies of a page count once in the sample."""
    page = lambda i: f"<html><body><nav>menu {i} <a href=x>home</a></nav><article><h1>T {i}</h1><p>one two three {i}</p><p>four five</p></article><footer>c {i}</footer></body></html>"
    rows = [(i, page(i)) for i in range(30)] + [(100 + i, page(0)) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id int, html string")
    weights = html.train(pages, max_pages=20)
    assert not {"article", "/article", "main", "mark"} & set(weights)
    for i, p in rows[:31]:
        want = f"T {i % 100}\n\none two three {i % 100}\n\nfour five"
        assert html.main_text(p, weights) == html.main_text(re.sub("</?article>", "", p), weights) == want
    texts = [r["text"] for r in html.extract_main(pages).where("page_id >= 100").collect()]
    assert len(texts) == 500 and len(set(texts)) == 1


def test_what_a_lost_attempt_left_is_not_read(spark, tmp_path):
    """Files of a former run stand in the folder; the manifest names those that count."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    folder = f"file://{tmp_path}/tokens"
    vocabulary = vocabulary_file("word_bpe_49k.json")
    first = tokenfile.read_tokens(tokenfile.write_tokens(docs, vocabulary, 2, folder=folder)).orderBy("doc_id").collect()
    again = tokenfile.read_tokens(tokenfile.write_tokens(docs, vocabulary, 2, folder=folder)).orderBy("doc_id").collect()
    assert first == again and [r["doc_id"] for r in again] == list(range(40))


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_boundaries_in_slices(monkeypatch, n):
    monkeypatch.setattr(tokenfile, "SLICE", 64)
    values = np.cumsum(np.random.default_rng(n).integers(0, 5000, n))
    made = tokenfile.EliasFano.encode(values, int(values[-1]) if n else 0)
    assert [made.select(i) for i in range(n)] == values.tolist() and made.block(0, n).tolist() == values.tolist()


def test_many_sources_join_by_salt(spark):
    rows = [(i, f"t{i}", None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 50}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    broadcast = mixing.mix(docs)
    salted = mixing.mix(docs, broadcast_bytes=0)
    assert salted.collect() == broadcast.collect()
    order = [r["shuffle_key"] for r in salted.select("shuffle_key").collect()]
    assert order == sorted(order) and len(set(order)) > 100
    plan = broadcast._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "rangepartitioning" not in plan


def test_copies_against_a_plain_inversion(spark):
    import hashlib
    import math

    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(90)] + [(900, "alone", "few")]
    got = {r["doc_id"]: r["n"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string"), total=500).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for i, text, source in rows:
        mean = 500 / 4 / (1 if source == "few" else 30)
        parts = max(1, math.ceil(mean / 16))
        n = 0
        for j in range(1, parts + 1):
            digest = hashlib.md5(f"42:{i}:{hashlib.md5(text.encode()).hexdigest()}:{j}".encode()).hexdigest()
            u, k, p = int(digest[:13], 16) / 2**52, 0, math.exp(-mean / parts)
            total = p
            while u >= total and k < 60:
                k += 1
                p *= mean / parts / k
                total += p
            n += k
        assert got.get(i, 0) == n, i


def test_folders_belong_to_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:8020")
        assert common.qualified(spark, "/shared/x") == "hdfs://127.0.0.1:8020/shared/x"
        assert common.qualified(spark, "file:/tmp/x") == common.qualified(spark, "file:///tmp/x") == "file:///tmp/x"
    finally:
        conf.set("fs.defaultFS", was)
    assert common.qualified(spark, "/tmp/x") == "file:///tmp/x"


def test_written_tables_go_when_released(spark):
    made = common.written(spark.range(3), "released")
    assert made.count() == 3
    common.released(made)
    with pytest.raises(Exception):
        spark.read.parquet(made.loom_folder).count()
