"""A document's parse: characters and objects of its pages, as readers give them, to blocks in reading order.

Pages part into columns at a wide gap, columns into bands around their tables and images, and the characters of a band into
lines and words by the gaps between them. Where too many of a band's tokens are long, its words have run together: it is
built again from finer words, with a table without lines where it has one, and every line stays by itself. Other bands'
lines go on in each other as text does. Fonts tell the blocks' types; what repeats at the margins of most pages goes.

Every step is a window, a partial aggregate or a join over a page, a column or a band of one, which are small; no page meets
another before the margins are counted. Pages are dealt into parts of about PART characters, however many there are of a
document, and a document's Markdown is that of its pages. Rows: pages (doc, page, page_width, page_height), chars (doc, page, x0, x1, top,
bottom, text, size, font), objects (doc, page, box, content, block_type). Rows without a document or a page number are no
part of any document; a page without characters or objects has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators import layout, pages
from loomdoc.session import stored

#: The gap in a line that parts its words, the finer one, the step between lines, and when tokens are long.
APART, FINE, STEP = 3.0, 2.0, 3.0
LONG, SHARE = 15, 0.08
BAND = ("column", "band")
PART = 1 << 18  # characters that a task has at a time


def _parted(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Rows dealt by keys into parts, one for every PART of `n`: what a task sorts and writes doesn't grow with the input.

    The number is given, as the bytes of a shuffle say little of its rows: like ones are small when packed, not in a sort.
    """
    return rows.repartition(max(1, -(-n // PART)), *by)


def _within(rows: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the column of the page that their middle is in: two columns at most for each."""
    sides = columns.select(*by, "column", F.col("x1").alias("left"), F.col("x2").alias("right"))
    middle = (F.col("x0") + F.col("x1")) / 2
    return rows.join(sides, by).where((middle >= F.col("left")) & (middle <= F.col("right"))).drop("left", "right")


def _in_areas(chars: DataFrame, columns: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Characters with the column and the band of it that their middle is in, by one join: the pages' few areas come to them."""
    sides = columns.select(*by, "column", F.col("x1").alias("left"), F.col("x2").alias("right"))
    areas = bands.select(*by, *BAND, "y1", "y2").join(sides, [*by, "column"])
    across, down = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (across >= F.col("left")) & (across <= F.col("right")) & (down >= F.col("y1")) & (down <= F.col("y2"))
    return chars.join(areas.hint("shuffle_hash"), by).where(inside).drop("left", "right", "y1", "y2")


def fine_words(chars: DataFrame, part: list[str]) -> DataFrame:
    """Words of the finer gap: part..., line, word, text, box, size, font, and `apart`, whether the wider gap is before it too.

    Characters go by top; one further below the last than STEP begins a line. Blank characters part words and go.
    """
    down = Window.partitionBy(*part).orderBy("top", "x0")
    rows = chars.withColumn("line", F.sum(F.when(F.col("top") - F.lag("top").over(down) > STEP, 1).otherwise(0)).over(down))
    across = Window.partitionBy(*part, "line").orderBy("x0", "x1", "text")
    blank = t.strip(F.col("text")) == ""
    gap = F.col("x0") - F.lag("x1").over(across)
    after = F.coalesce(F.lag(blank).over(across), F.lit(True))
    rows = rows.withColumn("apart", after | (gap > APART)).withColumn("new", after | (gap > FINE)).withColumn("blank", blank)
    rows = rows.withColumn("word", F.sum(F.when(F.col("new") | F.col("blank"), 1).otherwise(0)).over(across)).where(~F.col("blank"))
    letters = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    text = F.array_join(F.transform(letters, lambda x: x["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    return rows.groupBy(*part, "line", "word").agg(text.alias("text"), *box, F.avg("size").alias("size"), F.min_by("font", "x0").alias("font"), F.max("apart").alias("apart"))


def run_together(words: DataFrame, part: list[str]) -> DataFrame:
    """Fine words with `token`, the wider gap's word that each is in, and `rebuilt`: over SHARE of the band's tokens are longer than LONG."""
    across = Window.partitionBy(*part, "line").orderBy("word")
    rows = words.withColumn("token", F.sum(F.col("apart").cast("int")).over(across))
    size = F.sum(F.length("text")).over(Window.partitionBy(*part, "line", "token"))
    first = F.col("apart")  # a token counts once, at its first word
    whole = Window.partitionBy(*part)
    rows = rows.withColumn("size_of", size)
    share = F.count_if(first & (F.col("size_of") > LONG)).over(whole) / F.count_if(first).over(whole)
    return rows.withColumn("rebuilt", share > SHARE).drop("size_of")


def _typed(lines: DataFrame, fonts: DataFrame, usual: DataFrame, part: list[str], doc: str) -> DataFrame:
    """Lines with `heading` (weight or size over the usual) and `block_type`."""
    found = pages.with_fonts(lines, fonts, part).join(usual, doc)
    size, font = F.coalesce("size", "most_used"), F.coalesce("font", "usual_font")
    bold = (font != F.col("usual_font")) & (F.lower(font).contains("bold") | F.array_contains("bold_fonts", font))
    kind = layout.block_type(F.col("text"), size, font, F.col("most_used"), F.col("largest"), F.col("usual_font"), F.col("bold_fonts"))
    heading = bold | (size > F.col("most_used") + 0.4)
    return found.withColumn("heading", heading).withColumn("block_type", kind).select(*lines.columns, "heading", "block_type")


def usual_fonts(chars: DataFrame, doc: str) -> DataFrame:
    """Of each document: most_used and largest size, bold_fonts, usual_font, the commonest by visible characters (the first by name), and its number of characters."""
    n = F.sum(F.length(t.squeezed(F.col("text"))))
    fonts = chars.groupBy(doc, "font").agg(n.alias("n"), F.count("*").alias("all"))
    fonts = fonts.groupBy(doc).agg(F.min_by("font", F.struct(-F.col("n"), "font")).alias("usual_font"), F.sum("all").alias("characters"))
    return pages.bold_fonts(chars.select(doc, "size", "text", "font"), [doc]).join(fonts, doc)


def page_blocks(sheets: DataFrame, chars: DataFrame, objects: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """Blocks of pages: doc, page, column, band, reading_order (in the page), block_type, content, y1, x1."""
    by, own = [doc, page], [doc, page, "column"]
    part = [*own, "band"]
    usual = stored(usual_fonts(chars, doc), "parse-usual")
    total = usual.agg(F.sum("characters")).first()[0] or 0
    chars = _parted(chars, total, by)
    columns = stored(pages.page_columns(sheets, chars.where(t.strip(F.col("text")) != ""), by), "parse-columns")
    things = stored(_within(objects, columns, by), "parse-objects")
    heights = stored(columns.join(sheets.select(*by, "page_height"), by), "parse-pages")
    bands = stored(pages.text_bands(heights, things, own), "parse-bands")
    words = stored(run_together(fine_words(_in_areas(chars, columns, bands.where("text"), by), part), part), "parse-words")
    words = _parted(words, total, part)  # groups and joins of bands from here on find their rows in place
    fonts = _parted(stored(pages.font_lines(words, part), "parse-fonts"), total, part)

    # lines of tokens, which go on in each other
    glued = lambda order, sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), sign)
    tokens = words.where(~F.col("rebuilt")).groupBy(*part, "line", "token").agg(glued("word", "").alias("text"), F.min("top").alias("top"))
    lines = tokens.groupBy(*part, "line").agg(glued("token", " ").alias("text"), F.min("top").alias("top"))
    joined = pages.continued(_typed(lines, fonts, usual, part, doc), part)
    flowing = _typed(joined, fonts, usual, part, doc).join(bands.select(*part, "y1"), part).select(*part, F.lit(1).alias("kind"), F.col("line").cast("double").alias("at"), "y1", F.lit(0.0).alias("x1"), F.col("text").alias("content"), "block_type")

    # lines of fine words, and a table among them
    fine = words.where("rebuilt").withColumn("top", F.bround("top", 0).cast("double"))
    cells = pages.columnar_tables(fine.select(*part, "top", "x0", "x1", "text"), part)
    tables = cells.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.min("top").alias("first"), F.max("top").alias("last"))
    table = layout.markdown_table(F.get("rows", F.lit(0))["cells"], F.transform(F.slice("rows", 2, F.size("rows")), lambda r: r["cells"]))
    tabled = tables.select(*part, F.lit(0).alias("kind"), F.lit(0.0).alias("at"), F.col("first").alias("y1"), F.lit(0.0).alias("x1"), table.alias("content"), F.lit("table").alias("block_type"))
    built = fine.groupBy(*part, "top").agg(glued("x0", " ").alias("text")).join(tables.select(*part, "first", "last"), part, "left")
    built = built.where(F.col("first").isNull() | (F.col("top") < F.col("first") - 1) | (F.col("top") > F.col("last") + 15)).select(*part, F.col("top").alias("line"), "text", "top")
    alone = _typed(built, fonts, usual, part, doc).select(*part, F.lit(1).alias("kind"), F.col("top").alias("at"), F.col("top").alias("y1"), F.lit(0.0).alias("x1"), F.col("text").alias("content"), "block_type")

    shown = pages.in_bands(things, bands.where("not text"), own)
    shown = shown.select(*part, F.lit(0).alias("kind"), F.col("x0").cast("double").alias("at"), F.col("top").cast("double").alias("y1"), F.col("x0").cast("double").alias("x1"), "content", "block_type")
    blocks = _parted(flowing.unionByName(tabled).unionByName(alone).unionByName(shown), total, by)
    order = Window.partitionBy(*by).orderBy("column", "band", "kind", "at", "y1", "content")
    return blocks.select(*part, "block_type", "content", "y1", "x1", F.row_number().over(order).alias("reading_order"))


def document_blocks(sheets: DataFrame, chars: DataFrame, objects: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """Blocks of documents: doc, page, column, band, reading_order (in the document), block_type, content, y1, x1."""
    blocks = stored(page_blocks(sheets, chars, objects, doc, page), "parse-numbered")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = blocks.groupBy(doc, page).agg(F.count("*").alias("n")).select(doc, page, before.alias("before"))
    return blocks.join(ahead, [doc, page]).withColumn("reading_order", (F.col("reading_order") + F.col("before")).cast("int")).drop("before")


def without_margins(blocks: DataFrame, doc: str, page: str) -> DataFrame:
    """Blocks without what stands first or last on most pages, first and last by y1, x1 and the reading order."""
    place = F.row_number().over(Window.partitionBy(doc, page).orderBy("y1", "x1", "reading_order")).cast("double")
    ranked = blocks.withColumn("place", place).withColumnsRenamed({"y1": "own_y1", "x1": "own_x1", "place": "y1"}).withColumn("x1", F.lit(0.0))
    return layout.repeated_margins(ranked, doc, page).drop("y1", "x1").withColumnsRenamed({"own_y1": "y1", "own_x1": "x1"})


def document_parse(sheets: DataFrame, chars: DataFrame, objects: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """Markdown of each document: doc, markdown; that of a page is made with its blocks, and a document has those of its pages in order."""
    found = stored(page_blocks(sheets, chars, objects, doc, page), "parse-blocks")
    total = found.agg(F.sum(F.length("content"))).first()[0] or 0
    blocks = without_margins(_parted(found, total, [doc, page]), doc, page)
    rows = blocks.select(doc, F.col(page).alias("page_number"), F.col("reading_order").alias("position"), "block_type", "content")
    made = layout.compiled(rows, doc, "page_number").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_number", "markdown"))).alias("pages"))
    return made.select(doc, F.array_join(F.transform("pages", lambda x: x["markdown"]), "").alias("markdown"))


def characters(lines: DataFrame, keys: list[str], width: float = 4.0, gap: Column | float = 6.0, height: float = 10.0) -> DataFrame:
    """Characters of lines (keys..., text, x0, top, size, font) as a reader gives them: `width` each, words `gap` apart, no blanks.

    Lines are dealt by their keys before they are characters, so that no task makes all those of a large document.
    """
    lines = _parted(lines, lines.agg(F.sum(F.length("text"))).first()[0] or 0, keys)
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    letter = lines.select(*keys, F.col("x0").alias("left"), "top", "size", "font", gap.alias("gap"), F.col("text").alias("line_text"), F.posexplode(F.split("text", "")).alias("k", "text")).where("text not in ('', ' ')")
    blanks = F.col("k") - F.length(F.replace(F.substring("line_text", 1, F.col("k")), F.lit(" "), F.lit("")))
    x0 = F.col("left") + width * (F.col("k") - blanks) + F.col("gap") * blanks
    return letter.select(*keys, x0.alias("x0"), (x0 + width).alias("x1"), "top", (F.col("top") + height).alias("bottom"), "text", "size", "font")
