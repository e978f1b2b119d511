"""Articles and index together: reuse, emptied articles, failures that are undone, files that can't be taken, asset folders."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import index, lifecycle
from loomdoc.sources import office
from loomdoc.streaming import ingest

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def embedded(rows):
    return rows.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(1.0)))


def broken(rows):
    return rows.withColumn("embedding", F.array(F.raise_error(F.lit("no provider")).cast("double")))


def article(spark, *rows):
    made = spark.createDataFrame([(i, f"d{i}", "t", c, f) for i, c, f in rows], "id string, document_id string, title string, content string, source_file string")
    return made.withColumn("created_at", now()).withColumn("updated_at", now())


def contents(library):
    return {(r["article_id"], r["content"]) for r in library.index.read().collect()}


def library(spark, tmp_path, embed=embedded):
    return lifecycle.Library(spark, f"file://{tmp_path}/library", embed, keep=lambda df, name: df.coalesce(1).cache())


def test_articles_and_index_follow_each_other(spark, tmp_path):
    lib = library(spark, tmp_path)
    lib.create(article(spark, ("a", "# H\nfirst text", "a.docx"), ("b", "plain", "b.md")))
    assert contents(lib) == {("a", "## H\n\nfirst text"), ("b", "plain")}
    changes = spark.createDataFrame([("a", "# H\nsecond text", None)], "id string, content string, title string")
    lib.update(changes, now())
    assert contents(lib) == {("a", "## H\n\nsecond text"), ("b", "plain")}
    # an article whose text has no chunk keeps its row and loses its chunks
    lib.update(spark.createDataFrame([("a", "# only a heading", None)], "id string, content string, title string"), now())
    assert contents(lib) == {("b", "plain")} and lib.articles.read().count() == 2
    assert lib.delete(spark.createDataFrame([("b",)], "id string")) == 1
    assert contents(lib) == set() and [r["id"] for r in lib.articles.read().collect()] == ["a"]


def test_what_fails_is_undone(spark, tmp_path):
    lib = library(spark, tmp_path)
    lib.create(article(spark, ("a", "old text", "a.md")))
    before, versions = contents(lib), lib.articles.versions()
    lib.embed = broken
    with pytest.raises(lifecycle.IndexingError, match="no provider"):
        lib.update(spark.createDataFrame([("a", "new text")], "id string, content string"), now())
    with pytest.raises(lifecycle.IndexingError):
        lib.create(article(spark, ("c", "text", "c.md")))
    assert contents(lib) == before and lib.articles.versions() == versions
    assert [r["content"] for r in lib.articles.read().collect()] == ["old text"]
    # the index's own write fails after the articles' one
    lib.embed = embedded
    lib.index.write = lambda df: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(lifecycle.IndexingError, match="disk"):
        lib.create(article(spark, ("c", "text", "c.md")))
    assert [r["id"] for r in lib.articles.read().collect()] == ["a"]


def test_blank_articles_are_an_error(spark, tmp_path):
    lib = library(spark, tmp_path)
    with pytest.raises(ValueError, match="neither"):
        lib.create(article(spark, ("a", "  ", "a.md")))
    assert lib.articles.read().count() == 0


def test_equal_contents_keep_their_embedding(spark, tmp_path):
    lib = library(spark, tmp_path)
    lib.create(article(spark, ("a", "# A\none\n# B\ntwo", "a.docx")))
    lib.embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(-1.0)))
    lib.update(spark.createDataFrame([("a", "# A\none\n# B\nthree")], "id string, content string"), now())
    assert {r["content"]: r["embedding"][0] for r in lib.index.read().collect()} == {"## A\n\none": 9.0, "## B\n\nthree": -1.0}


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_files_become_articles_once(spark, tmp_path):
    lib = library(spark, tmp_path)
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.docx").write_bytes(docx("a sentence"))
    (files / "copy.docx").write_bytes(docx("a sentence"))
    (files / "b.docx").write_bytes(b"broken")
    (files / "c.xyz").write_bytes(b"unknown")
    for _ in range(2):
        rejected = lib.ingest(office.read_files(spark, f"file://{files}"), now()).collect()
        assert {(r["source_file"], r["reason"].split(":")[0]) for r in rejected} == {("b.docx", "BadZipFile"), ("c.xyz", "unsupported_format")}
    (row,) = lib.articles.read().collect()
    assert row["content"].endswith("a sentence") and len(contents(lib)) == 1
    assert lifecycle.converted(office.read_files(spark, f"file://{files}"), most=3)[1].where("reason = 'too_large'").count() == 4


def test_seeds_are_there_after(spark, tmp_path):
    lib = library(spark, tmp_path)
    corpus = spark.createDataFrame([("c1", "x", "x.md", "u", "text one"), ("c2", "y", "y.md", "u", "text two")], "id string, article_id string, source_file string, source_url string, text string")
    for _ in range(2):
        lib.seed(corpus, now())
    assert contents(lib) == {("x", "text one"), ("y", "text two")}
    assert [r[0] for r in lifecycle.missing_ids(lib.index.read(), spark.createDataFrame([("x",), ("z",)], "article_id string")).collect()] == ["z"]


def test_only_a_documents_own_folder_goes(tmp_path):
    for name in ("d1", "d2"):
        (tmp_path / "assets" / name).mkdir(parents=True)
        (tmp_path / "assets" / name / "i.png").write_bytes(b"x")
    folder = f"file://{tmp_path}/assets"
    assert not any(lifecycle.remove_assets(folder, x) for x in ("", "..", ".", "../d1", "d1/..", "none"))
    assert lifecycle.remove_assets(folder, "d1") and not (tmp_path / "assets" / "d1").exists() and (tmp_path / "assets" / "d2").exists()


def test_two_writers_of_a_version(spark, tmp_path):
    one, two = (index.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.write(spark.range(1))
    two.versions = lambda: []  # it looked before the other one wrote
    with pytest.raises(Exception):
        two.write(spark.range(2))
    assert one.read().count() == 1


def test_broken_files_of_a_stream_are_listed(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.docx").write_bytes(docx("fine"))
    (source / "b.docx").write_bytes(b"broken")
    ingest.ingest_files(spark, str(source), str(target), str(tmp_path / "state")).awaitTermination()
    assert [r["content"] for r in spark.read.parquet(str(target / "chunks")).collect()] == ["## a\n\nfine"]
    assert [r["source_file"] for r in spark.read.parquet(str(target / "rejected")).collect()] == ["b.docx"]


def test_problems_are_listed_in_order(spark):
    checked = spark.createDataFrame([(f"{i:03}", "stale" if i % 2 else None) for i in range(50)] + [("x", "orphan")], "chunk_id string, problem string")
    rows = index.listed(checked, 3).collect()
    assert [tuple(r) for r in rows] == [("orphan", 1, "x"), ("stale", 25, "001, 003, 005 ... and 22 more")]


def test_chunks_of_an_article_go_with_their_number(spark):
    chunks = spark.createDataFrame([("1", "a", "f"), ("2", "a", None), ("3", None, "f"), ("4", "b", "g")], "chunk_id string, article_id string, source_file string")
    left, n = index.without(chunks, article_id="a", source_file="f")
    assert n == 3 and [r["chunk_id"] for r in left.collect()] == ["4"]
    with pytest.raises(ValueError):
        index.without(chunks, article_id=" ")
