"""The parse of pages from characters, on hand-made pages."""

from pyspark.sql import functions as F

from loomdoc.operators import parse
from loomdoc.session import stored

SHEET = "d string, p int, page_width double, page_height double"
LINE = "d string, p int, x0 double, top double, size double, font string, text string"
OBJECT = "d string, p int, x0 double, top double, x1 double, bottom double, content string, block_type string"


def blocks(spark, lines, objects=(), gap=6.0, pages=((1, 600.0, 800.0),)):
    sheets = spark.createDataFrame([("d", *p) for p in pages], SHEET)
    chars = parse.characters(spark.createDataFrame([("d", *x) for x in lines], LINE), ["d", "p"], gap=gap)
    things = spark.createDataFrame([("d", *x) for x in objects], OBJECT)
    return sheets, chars, things


def contents(found):
    return [(r["block_type"], r["content"]) for r in found.orderBy("reading_order").collect()]


def test_lines_go_on_around_objects(spark):
    lines = [(1, 60.0, 50.0, 18.0, "Sans-Bold", "A Title"), (1, 60.0, 80.0, 10.0, "Sans", "the text begins"), (1, 60.0, 95.0, 10.0, "Sans", "and ends."), (1, 60.0, 110.0, 10.0, "Sans", "Another one"), (1, 60.0, 130.0, 10.0, "Sans", "- item"), (1, 60.0, 400.0, 10.0, "Sans", "below the image")]
    objects = [(1, 60.0, 200.0, 100.0, 300.0, "left.png", "image"), (1, 150.0, 190.0, 200.0, 280.0, "right.png", "image")]
    found = parse.document_blocks(*blocks(spark, lines, objects), "d", "p")
    assert contents(found) == [("h1", "A Title"), ("paragraph", "the text begins and ends."), ("paragraph", "Another one"), ("list_item", "- item"), ("image", "left.png"), ("image", "right.png"), ("paragraph", "below the image")]


def test_words_that_run_together_are_built_again(spark):
    """Every line by itself, and a table without lines among them."""
    lines = [(1, 60.0, 50.0, 10.0, "Sans", "some words of a long line"), (1, 60.0, 80.0, 10.0, "Sans", "another long line of words")]
    cells = [(1, 60.0 + 50 * c, 200.0 + 30 * r, 10.0, "Sans", f"{'abc'[c]}{r}") for r in range(4) for c in range(3)]
    after = [(1, 60.0, 400.0, 10.0, "Sans", "the very last line of it all")]
    found = parse.document_blocks(*blocks(spark, lines + cells + after, gap=2.5), "d", "p")
    got = contents(found)
    assert ("table", "| a0 | b0 | c0 |\n| --- | --- | --- |\n| a1 | b1 | c1 |\n| a2 | b2 | c2 |\n| a3 | b3 | c3 |") in got
    assert [c for k, c in got if k != "table"] == ["some words of a long line", "another long line of words", "the very last line of it all"]


def test_nulls_blanks_and_nothing(spark):
    sheets, chars, things = blocks(spark, [(1, 60.0, 50.0, 10.0, "Sans", "a b"), (2, 60.0, 50.0, 10.0, "Sans", "x y")], pages=((1, 600.0, 800.0), (2, 600.0, 800.0), (3, 600.0, 800.0)))
    blank = chars.limit(1).withColumn("text", F.lit(" ")).withColumn("x0", F.lit(300.0)).withColumn("x1", F.lit(304.0))
    lost = chars.limit(1).withColumn("p", F.lit(None).cast("int"))
    found = parse.document_blocks(sheets, chars.unionByName(blank).unionByName(lost), things, "d", "p")
    assert contents(found) == [("paragraph", "a b"), ("paragraph", "x y")]
    assert parse.document_parse(sheets, chars.limit(0), things, "d", "p").count() == 0
    assert parse.document_parse(sheets.limit(0), chars, things, "d", "p").count() == 0


def test_repeated_margins_go(spark):
    lines = [(p, 60.0, 20.0, 10.0, "Sans", "Running head") for p in (1, 2, 3)] + [(p, 60.0, 300.0 + 100 * k, 10.0, "Sans", f"Page {p} line {k}.") for p in (1, 2, 3) for k in range(3)]
    things = [(p, 60.0, 100.0, 90.0, 120.0, f"i{p}.png", "image") for p in (1, 2, 3)]
    made = parse.document_parse(*blocks(spark, lines, things, pages=tuple((p, 600.0, 800.0) for p in (1, 2, 3))), "d", "p").first()["markdown"]
    assert "Running head" not in made
    assert made.count("<!-- page:") == 3 and all(f"Page {p} line {k}." in made for p in (1, 2, 3) for k in range(3))


def test_pages_of_one_document_are_dealt(spark, monkeypatch):
    """No task makes or sorts most of a document, however few bytes its shuffles have; its pages stay in order."""
    monkeypatch.setattr(parse, "PART", 300, raising=False)
    most = {}

    def watched(df, name):
        rows = stored(df.withColumn("task", F.spark_partition_id()), name)
        found = [r["count"] for r in rows.groupBy("task").count().collect()]
        most[name] = max(found, default=0) / max(1, sum(found))
        return rows.drop("task")

    monkeypatch.setattr(parse, "stored", watched)
    lines = [(p, 60.0, 200.0 + 100 * k, 10.0, "Sans", f"Page {p} has line {k}.") for p in range(1, 41) for k in range(4)]
    sheets, chars, things = blocks(spark, lines, pages=tuple((p, 600.0, 800.0) for p in range(1, 41)))
    made = parse.document_parse(sheets, chars, things, "d", "p").first()["markdown"]
    assert made == "".join(f"\n<!-- page: {p} -->\n" + "".join(f"Page {p} has line {k}.\n" for k in range(4)) for p in range(1, 41))
    assert most["parse-words"] < 0.5 and most["parse-blocks"] < 0.5
    shares = [r["count"] for r in chars.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 0.5 * sum(shares)
