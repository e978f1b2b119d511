"""Office files by the data source, in one read and as a stream."""

import time

import pytest

from loomdoc.sources import datasource, office


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(office.workbook({"One & two": [["k", "v"], ["1", "<x>"], ["", ""], ["2"]], "Empty": [], "Three": [["z"]]}))
    (tmp_path / "deep" / "b.XLSX").write_bytes(office.workbook({"S": [["only"]]}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "deck.pptx").write_bytes(office.presentation([("First & last", ["one", "two <b>"]), ("", [])]))
    (tmp_path / "other.txt").write_text("no office file")
    return tmp_path


def rows(spark, folder, kind, **options):
    datasource.register(spark)
    return spark.read.format("office").options(rows=kind, **options).load(str(folder))


@pytest.mark.parametrize("split", ["1", str(datasource.SPLIT)])
def test_sheets(spark, folder, split):
    found = rows(spark, folder, "sheets", split=split)
    assert found.rdd.getNumPartitions() == (3 if split == "1" else 1)
    got = sorted(((r["path"].rpartition("/")[2], r["sheet"], r["row"], r["cells"]) for r in found.where("error is null").collect()), key=str)
    assert got == [("a.xlsx", "One & two", 0, ["k", "v"]), ("a.xlsx", "One & two", 1, ["1", "<x>"]), ("a.xlsx", "One & two", 2, ["2", ""]), ("a.xlsx", "Three", 0, ["z"]), ("b.XLSX", "S", 0, ["only"])]
    broken = found.where("error is not null").collect()
    assert [(r["path"].rpartition("/")[2], r["sheet"], r["error"].partition(":")[0]) for r in broken] == [("broken.xlsx", None, "BadZipFile")]


def test_slides_and_markdown(spark, folder):
    got = [(r["slide"], r["title"], r["body"], r["notes"], r["error"]) for r in rows(spark, folder, "slides").orderBy("slide").collect()]
    assert got == [(1, "First & last", ["* one\n* two <b>"], [], None), (2, "", [], [], None)]
    made = {r["path"].rpartition("/")[2]: (r["markdown"], r["error"]) for r in rows(spark, folder, "markdown").collect()}
    assert set(made) == {"a.xlsx", "b.XLSX", "broken.xlsx", "deck.pptx"}
    assert made["b.XLSX"][0] == "# b\n\n## Sheet: S\n\n| only |\n| --- |" and made["broken.xlsx"][0] is None and made["deck.pptx"][1] is None


def test_one_file_no_files_and_no_folder(spark, folder, tmp_path):
    assert rows(spark, folder / "a.xlsx", "sheets").count() == 4
    (tmp_path / "none").mkdir()
    assert rows(spark, tmp_path / "none", "slides").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError|missing"):
        rows(spark, tmp_path / "missing", "slides").count()


def test_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    datasource.register(spark)
    out, state = (str(tmp_path_factory.mktemp(x)) for x in ("out", "state"))

    def run():
        stream = spark.readStream.format("office").option("rows", "sheets").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"].rpartition("/")[2], r["sheet"] or "", r["row"] or 0) for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 6
    time.sleep(0.05)
    (folder / "late.xlsx").write_bytes(office.workbook({"L": [["x"], ["y"]]}))
    assert run() == sorted([*first, ("late.xlsx", "L", 0), ("late.xlsx", "L", 1)])
    assert run() == sorted([*first, ("late.xlsx", "L", 0), ("late.xlsx", "L", 1)])


def test_files_are_written_whole(tmp_path):
    path = datasource.write_file(str(tmp_path / "new"), "f.bin", b"abc")
    assert datasource.write_file(str(tmp_path / "new"), "f.bin", b"abc") == path
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "new").iterdir()] == [("f.bin", b"abc")]
