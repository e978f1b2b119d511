"""Commits that write touched buckets only, and ways back."""

import pytest

from loomdoc.operators.buckets import BucketedTable, bucket_of


@pytest.fixture
def table(spark, tmp_path):
    out = BucketedTable(spark, str(tmp_path / "t"), "article", 16)
    rows = [(i if i else None, n, f"text {i} {n}", 7) for i in range(60) for n in range(3)]
    out.write(spark.createDataFrame(rows, "article int, n int, text string, commit int").drop("commit"))
    return out


def rows_of(df):
    return sorted(((r["article"], r["n"], r["text"]) for r in df.collect()), key=str)


def test_a_commit_writes_touched_buckets(spark, table, tmp_path):
    before = rows_of(table.read())
    assert len(before) == 180
    keys = spark.createDataFrame([(5,), (17,), (None,), (999,), (5,)], "article int")
    new = spark.createDataFrame([(5, 0, "new five"), (None, 1, "new null")], "article int, n int, text string")
    version, touched = table.commit(new, keys)
    assert version == 2 and touched == sorted({r[0] for r in keys.select(bucket_of(keys["article"], 16)).collect()})
    want = sorted([r for r in before if r[0] not in (5, 17, None)] + [(5, 0, "new five"), (None, 1, "new null")], key=str)
    assert rows_of(table.read()) == want and rows_of(table.read(1)) == before
    folders = sorted((tmp_path / "t").glob("commit=*"), key=lambda p: len(list(p.glob("bucket=*"))))
    assert len(list(folders[0].glob("bucket=*"))) <= len(touched) < 16
    assert {r["bucket"] for r in table.read(buckets=touched).collect()} <= set(touched)
    # back: one bucket, then everything
    bucket = table.read(buckets=None).where("article = 5").first()["bucket"]
    assert table.rollback_bucket(bucket) == 3
    got = rows_of(table.read())
    assert [r for r in got if r[0] == 5] == [r for r in before if r[0] == 5] and (None, 1, "new null") in got
    assert table.rollback() == 2 and rows_of(table.read()) == want
    assert table.rollback() == 1 and rows_of(table.read()) == before
    with pytest.raises(ValueError):
        table.rollback()


def test_emptied_buckets_and_old_versions(spark, table):
    whole = table.read().select("article")
    version, touched = table.commit(spark.createDataFrame([], "article int, n int, text string"), whole)
    assert table.read().count() == 0 and table.read().columns == ["article", "n", "text", "bucket"]
    assert table.commit(spark.createDataFrame([], "article int, n int, text string"), whole.limit(0)) == (version, [])
    assert table.vacuum(1) == len(touched) and table.versions() == [2] and table.read().count() == 0
    with pytest.raises(ValueError):
        BucketedTable(spark, "x", "k", 0)
    with pytest.raises(FileNotFoundError):
        BucketedTable(spark, table.path + "-none", "k").read()


def test_a_commit_reads_touched_files_only(spark, table):
    files = table.read(buckets=[3, 9]).inputFiles()
    assert files and all("/bucket=3/" in f or "/bucket=9/" in f for f in files)
