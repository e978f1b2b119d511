"""Components on long paths, stars and many rounds; their guard."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.llm import simhash


def roots(edges):
    """The smallest name reachable, by a plain union-find."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_any_shape(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(1000, 1400)]
    star = [(1, 2000 + i) for i in range(6000)]
    some = [(rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(260)]
    edges = [*path, *star, *some, (7, 7)]
    rng.shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    want = {v: r for v, r in roots(edges).items() if v != r}
    assert {r["v"]: r["root"] for r in found.collect()} == want


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FOREST", 1)  # nothing is contracted within a partition
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        with pytest.raises(RuntimeError, match="after 1 rounds"):
            simhash.components(path, rounds=1)
        assert {r["root"] for r in simhash.components(path).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_depth_follows_the_points(spark, monkeypatch):
    """Deep trees over few points lose no link; leaves are joined by a shuffle where they aren't broadcast."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = sorted({p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in base for _ in range(4)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = roots([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    monkeypatch.setattr(simhash, "LEAF", 3)
    monkeypatch.setattr(simhash, "LEAVES", 10)
    points = spark.createDataFrame([(p, p, None) for p in signed], "print long, id long, wide binary")
    found = simhash.components(simhash.links(points))
    assert {r["v"]: r["root"] for r in found.collect()} == {v: r for v, r in want.items() if v != r}
