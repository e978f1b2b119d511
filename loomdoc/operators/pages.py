"""Pages of a document from rows that readers give: characters, words, spans, images, tables and recognised words.

Readers of PDF and image files are providers; what they give are rows, and the layout of a page is joins and windows over
them. Boxes are x0, top, x1, bottom in points from the page's top left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators import layout

BOLD_FLAG = 16
#: What confidence a recogniser's word needs, and what its confidence of 1 is.
RECOGNISERS = {"tesseract": (40.0, 100.0), "easyocr": (0.4, 1.0)}
#: Dots that stand for a list mark, and marks of list items before spans of a known weight.
DOT, SPAN_MARK = "•", r"^(?:[-*•●–] |\d+[.|)])"


def _text(order: Column, text: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), text.alias("text")))), lambda x: x["text"]), glue)


def _box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]


def span_lines(spans: DataFrame, by: list[str]) -> DataFrame:
    """Lines from spans (by..., line, span, text, size, flags, box): text, largest size, whether a span is bold; blank ones go."""
    bold = F.max((F.col("flags").bitwiseAND(BOLD_FLAG) != 0).cast("int")) == 1
    text = t.strip(_text(F.col("span"), F.col("text"), ""))
    return spans.groupBy(*by, "line").agg(text.alias("text"), F.max("size").alias("size"), bold.alias("bold"), *_box()).where("text <> ''")


def font_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """Font by line of words (by..., x0, top, text, size, font): key (lower case without white space), mean size, commonest font, top.

    Words of a line have tops that round to the same tenth; of fonts that are as common, the leftmost counts.
    """
    rows = words.withColumn("bucket", F.bround("top", 1))
    sized = F.when(F.col("size") > 0, F.col("size"))
    held = F.collect_list(F.struct(F.col("x0").alias("at"), "text")).alias("words")
    fonts = rows.groupBy(*by, "bucket", "font").agg(F.count("*").alias("n"), F.min("x0").alias("left"), held, F.sum(sized).alias("sum"), F.count(sized).alias("sized"))
    common = F.max_by("font", F.when((F.col("font") != "") & F.col("bucket").isNotNull(), F.struct("n", -F.col("left"))))
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("words"))), lambda x: x["text"]), " ")
    size = F.coalesce(F.try_divide(F.sum("sum"), F.sum("sized")).cast("double"), F.lit(0.0))
    lines = fonts.groupBy(*by, "bucket").agg(text.alias("text"), size.alias("size"), common.alias("font"))
    found = lines.withColumn("key", t.squeezed(F.col("text"))).where("key <> ''")
    last = F.row_number().over(Window.partitionBy(*by, "key").orderBy(F.desc("bucket")))
    first = F.min("bucket").over(Window.partitionBy(*by, "key"))
    return found.withColumn("last", last).withColumn("bucket", first).where("last = 1").select(*by, "key", "size", F.coalesce("font", F.lit("")).alias("font"), F.col("bucket").alias("top"))


def with_fonts(lines: DataFrame, fonts: DataFrame, by: list[str], key: str = "line") -> DataFrame:
    """Lines (by..., key, text) with size and font of the line with the same key, else of the first whose key is in theirs or has it.

    A page's fonts come to its lines as one array, by a join on the page alone. Lines without a page or a key go.
    """
    known = lines.where(" and ".join(f"`{c}` is not null" for c in [*by, key]))
    rows = known.withColumn("own", t.squeezed(F.col("text")))
    held = fonts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("top", "key", "size", "font"))).alias("fonts"))
    first = lambda test: F.get(F.filter("fonts", test), F.lit(0))
    own = F.col("own")
    near = lambda f: f["top"].isNotNull() & (F.contains(own, f["key"]) | F.contains(f["key"], own))
    found = rows.join(held, by, "left").withColumn("found", F.coalesce(first(lambda f: f["key"] == own), first(near)))
    return found.select(*lines.columns, "found.size", "found.font")


def bold_fonts(spans: DataFrame, by: list[str]) -> DataFrame:
    """Size used most and largest size (layout.font_mode), and the set of fonts with bold in their name. spans: size, text, font."""
    named = spans.where(F.lower("font").contains("bold")).groupBy(*by).agg(F.array_sort(F.collect_set("font")).alias("bold_fonts"))
    return layout.font_mode(spans, by).join(named, by, "left").withColumn("bold_fonts", F.coalesce("bold_fonts", F.array().cast("array<string>")))


def flagged_type(text: Column, size: Column, bold: Column, usual: Column, largest: Column) -> Column:
    """Struct (content, block_type) of a line whose weight is a flag: list mark, size, weight; a dot becomes a list mark."""
    bare = t.strip(layout.repaired(text))
    dotted = bare.startswith(DOT) & ~bare.rlike(SPAN_MARK)
    kind = (
        F.when(bare.rlike(SPAN_MARK) | dotted, "list_item")
        .when(size > usual + 0.4, F.when(size >= largest - 0.5, "h1").otherwise("h2"))
        .when(bold & bare.rlike(layout.STEPS), "h2")
        .when(bold & layout.heading_like(bare), F.when(t.word_count(bare) <= 10, "h1").otherwise("h2"))
        .otherwise("paragraph")
    )
    content = F.when(dotted, F.concat(F.lit("- "), t.strip(F.substring(bare, 2, 1 << 30)))).otherwise(bare)
    return F.struct(content.alias("content"), kind.alias("block_type"))


def continued(lines: DataFrame, by: list[str], item: Column | None = None) -> DataFrame:
    """Lines (by..., line, text, heading, top) joined where one goes on in the next: by..., line, text, top of the first.

    Headings go on in headings, list items stand alone, and text goes on unless it ends a sentence and the next begins one.
    Where a reader knows which lines are items, `item` says so; else their marks do.
    """
    order = Window.partitionBy(*by).orderBy("line")
    rows = lines.withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    kind = F.when(F.col("text").rlike(layout.LIST_MARK) if item is None else item, "item").when(F.col("heading"), "heading").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("was", F.lag("kind").over(order)).withColumn("before", F.lag("text").over(order))
    begins = F.left("text", F.lit(1))
    lower = (begins == F.lower(begins)) & (begins != F.upper(begins))
    open_end = ~F.col("before").rlike(r"[.!?:]$") | lower
    joins = (F.col("kind") == F.col("was")) & ((F.col("kind") == "heading") | ((F.col("kind") == "text") & open_end))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    return rows.groupBy(*by, "run").agg(F.min("line").alias("line"), _text(F.col("line"), F.col("text"), " ").alias("text"), F.min_by("top", "line").alias("top")).drop("run")


def swept_lines(words: DataFrame, by: list[str], key: str = "word_id") -> DataFrame:
    """Words with `line`: a word is of the last line if it overlaps its first word by over half of the smaller height.

    Words go by top, then x0, then key. Where nothing reaches over a word's top, a line begins whatever its first word was;
    between such places, few words are left, and one fold over their heights finds the lines.
    """
    order = Window.partitionBy(*by).orderBy("top", "x0", key)
    reach = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = words.withColumn("reach", reach).withColumn("part", F.sum(F.when(F.coalesce(F.col("top") < F.col("reach"), F.lit(False)), 0).otherwise(1)).over(order))
    word = F.struct("top", "x0", F.col(key).alias("key"), "bottom")
    parts = rows.groupBy(*by, "part").agg(F.array_sort(F.collect_list(word)).alias("words"))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, w: Column) -> Column:
        least = F.least(w["bottom"] - w["top"], s["bottom"] - s["top"])
        shared = F.least(w["bottom"], s["bottom"]) - F.greatest(w["top"], s["top"])
        same = (F.size(s["starts"]) > 0) & (least > 0) & (shared > 0.5 * least)
        new = F.struct(w["top"].cast("double").alias("top"), w["bottom"].cast("double").alias("bottom"), (s["at"] + 1).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
        return F.when(same, F.struct(s["top"].alias("top"), s["bottom"].alias("bottom"), (s["at"] + 1).alias("at"), s["starts"].alias("starts"))).otherwise(new)

    cut = parts.withColumn("starts", F.aggregate("words", start, step, lambda s: s["starts"]))
    found = cut.select(*by, "starts", F.posexplode("words").alias("at", "w")).withColumn("first", F.array_contains("starts", F.col("at")))
    numbered = found.withColumn("line", F.sum(F.col("first").cast("int")).over(Window.partitionBy(*by).orderBy("w")) - 1)
    return words.join(numbered.select(*by, F.col("w.key").alias(key), "line"), [*by, key])


def lines_of(words: DataFrame, by: list[str]) -> DataFrame:
    """Lines of words with `line`: text from left to right, mean height and confidence, box; blank ones go."""
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in words.columns else F.lit(1.0)
    text = t.strip(_text(F.col("x0"), F.col("text"), " "))
    return words.groupBy(*by, "line").agg(text.alias("text"), F.avg(F.col("bottom") - F.col("top")).alias("height"), F.avg(confidence).alias("confidence"), *_box()).where("text <> ''")


def recognised_words(words: DataFrame, recogniser: str) -> DataFrame:
    """Recognised words that are sure enough and not blank, their confidence from 0 to 1."""
    least, whole = RECOGNISERS[recogniser]
    return words.where((F.col("confidence") >= least) & (t.strip(F.col("text")) != "")).withColumn("confidence", F.col("confidence") / whole)


def recognition(regions: DataFrame, by: list[str]) -> DataFrame:
    """What was recognised: the regions' texts in order, a line each, their mean confidence and number."""
    return regions.groupBy(*by).agg(_text(F.col("position"), F.col("text"), "\n").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").cast("int").alias("regions"))


def cached(images: DataFrame, cache: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """Images with what the cache has of them, and those to recognise; entries without text are as good as none."""
    good = cache.where(F.col("text").isNotNull()).dropDuplicates([digest])
    return images.join(good, digest), images.join(good.select(digest), digest, "left_anti")


def _size() -> tuple[Column, Column]:
    return F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")


def page_images(images: DataFrame) -> DataFrame:
    """Images (box, page_width, page_height) that count: 10 points each way at least, and no more than 90 % of the page."""
    w, h = _size()
    return images.where((w >= 10) & (h >= 10) & (w * h / (F.col("page_width") * F.col("page_height")) <= 0.9))


def worth_reading(images: DataFrame, on: bool = True) -> DataFrame:
    """Images with `read`: large enough for text (36 by 18 points, 0.2 % of the page)."""
    w, h = _size()
    area = F.col("page_width") * F.col("page_height")
    return images.withColumn("read", F.lit(on) & (w >= 36) & (h >= 18) & (w * h / area >= 0.002))


def page_reading(pages: DataFrame, words: DataFrame, images: DataFrame, by: list[str]) -> DataFrame:
    """Pages (by..., page_width, page_height) with characters, image coverage and `read`: no words, or few over a large image."""
    w, h = (F.greatest(F.lit(0.0), x) for x in _size())
    written = words.groupBy(*by).agg(F.count("*").alias("words"), F.sum(F.length("text")).alias("characters"))
    drawn = images.groupBy(*by).agg(F.sum(w * h).alias("drawn"))
    rows = pages.join(written, by, "left").join(drawn, by, "left").fillna(0, ["words", "characters", "drawn"])
    coverage = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("drawn"), F.col("page_width") * F.col("page_height"))), F.lit(0.0))
    rows = rows.withColumn("coverage", coverage)
    return rows.withColumn("read", (F.col("words") == 0) | ((F.col("characters") < 20) & (F.col("coverage") >= 0.5))).drop("words", "drawn")


def text_bands(pages: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """What tables and images leave of a page: by..., band, y1, y2, and `text` (false for the objects' own bands).

    pages: by..., page_height; objects: by..., top, bottom. Objects that overlap or nearly touch are one band.
    """
    taken = layout.bands(objects.select(*by, F.col("top").alias("y1"), F.col("bottom").alias("y2")), by).select(*by, "y1", "y2")
    edges = pages.select(*by, F.lit(0.0).alias("y1"), F.lit(0.0).alias("y2")).unionByName(pages.select(*by, F.col("page_height").alias("y1"), F.col("page_height").alias("y2")))
    free = layout.gaps_between(taken.unionByName(edges), by)
    both = taken.withColumn("text", F.lit(False)).unionByName(free.withColumn("text", F.lit(True)))
    return both.withColumn("band", F.row_number().over(Window.partitionBy(*by).orderBy("y1", "y2")))


def in_bands(boxes: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Boxes with the band that their centre is in; those without one go. bands: by..., band, y1, y2, and x1, x2 where it has columns."""
    middle = (F.col("top") + F.col("bottom")) / 2
    inside = (middle >= F.col("y1")) & (middle <= F.col("y2"))
    named = bands.select(*by, "band", "y1", "y2", *([F.col("x1").alias("left"), F.col("x2").alias("right")] if "x1" in bands.columns else []))
    if "x1" in bands.columns:
        across = (F.col("x0") + F.col("x1")) / 2
        inside = inside & (across >= F.col("left")) & (across <= F.col("right"))
    return boxes.join(named, by).where(inside).drop("left", "right")


def page_columns(pages: DataFrame, chars: DataFrame, by: list[str]) -> DataFrame:
    """Columns of pages: by..., column, x1, x2; two where the middle of the page has a wide gap."""
    gap = layout.column_gap(chars.join(pages.select(*by, "page_width"), by), by).select(*by, F.col("center").alias("cut"))
    rows = pages.select(*by, "page_width").join(gap, by, "left")
    whole = F.array(F.struct(F.lit(0.0).alias("x1"), F.col("page_width").cast("double").alias("x2")))
    halves = F.array(F.struct(F.lit(0.0).alias("x1"), F.col("cut").alias("x2")), F.struct(F.col("cut").alias("x1"), F.col("page_width").cast("double").alias("x2")))
    return rows.select(*by, F.posexplode(F.when(F.col("cut").isNull(), whole).otherwise(halves)).alias("column", "c")).select(*by, "column", "c.x1", "c.x2")


def assembled(pages: DataFrame, columns: DataFrame, lines: DataFrame, objects: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """Blocks of documents in reading order: page by page, column by column, bands from the top, a band's objects from the left.

    lines: doc, page, box, line, content, block_type; objects (tables and images): doc, page, box, content, block_type. Every
    column has bands of its own, as its objects leave them. Repeated margins go, and numbers follow the order.
    """
    by = [doc, page]
    within = lambda rows: rows.join(columns.select(*by, "column", F.col("x1").alias("left"), F.col("x2").alias("right")), by).where(((F.col("x0") + F.col("x1")) / 2 >= F.col("left")) & ((F.col("x0") + F.col("x1")) / 2 <= F.col("right"))).drop("left", "right")
    own = [*by, "column"]
    things, texts = within(objects), within(lines)
    bands = text_bands(columns.join(pages.select(*by, "page_height"), by), things, own)
    text = in_bands(texts, bands.where("text"), own).select(*own, "band", "x0", "top", "x1", "bottom", F.lit(0.0).alias("across"), F.col("line").cast("double").alias("down"), "content", "block_type")
    other = in_bands(things, bands.where("not text"), own).select(*own, "band", "x0", "top", "x1", "bottom", F.col("x0").cast("double").alias("across"), F.col("top").cast("double").alias("down"), "content", "block_type")
    order = Window.partitionBy(doc).orderBy(page, "column", "band", "across", "down")
    rows = text.unionByName(other).withColumn("reading_order", F.row_number().over(order))
    blocks = rows.withColumn("block_id", F.col("reading_order")).withColumn("y1", F.col("top").cast("double"))
    kept = layout.repeated_margins(blocks.withColumn("box_x1", F.col("x1")).withColumn("x1", F.col("x0").cast("double")), doc, page)
    return layout.reading_order(kept.withColumnRenamed(page, "page_number"), [doc]).drop("across", "down", "y1", "x1", "block_id").withColumnRenamed("box_x1", "x1")


def absolute(shapes: DataFrame, groups: DataFrame, key: str = "group_id") -> DataFrame:
    """Boxes of shapes in a group's own coordinates as boxes on the slide: scaled and moved; shapes of no group stay.

    groups: key, x, y, width, height (on the slide), and inner_x, inner_y, inner_width, inner_height.
    """
    rows = shapes.join(groups, key, "left")
    scale = lambda outer, inner: F.coalesce(F.try_divide(F.col(outer), F.col(inner)), F.lit(1.0))
    moved = lambda c, axis, size: F.when(F.col("x").isNull(), F.col(c)).otherwise(F.col(axis) + (F.col(c) - F.col(f"inner_{axis}")) * scale(size, f"inner_{size}"))
    box = {c: moved(c, "x", "width") for c in ("x1", "x2")} | {c: moved(c, "y", "height") for c in ("y1", "y2")}
    return rows.withColumns(box).select(*shapes.columns)


def _in_pairs(lines: Column, could: Callable[[Column, Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """Lines where one that could, by itself and the next, takes the next one in, which then takes none; `next` of `both` is null where it takes none.

    So in a run of neighbours that could, every second one does, and what follows a run of odd length is taken too: runs end
    with the line that couldn't, and are read in twos.
    """
    able = F.transform(lines, lambda x, i: F.coalesce(could(x, F.get(lines, i + 1)), F.lit(False)))

    def paired(able: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: ~F.get(able, i - 1))
        run = lambda end, begin: F.transform(F.sequence(begin, end, F.lit(2)), lambda i: both(F.get(lines, i - 1), F.when(i < end, F.get(lines, i))))
        return F.flatten(t.let(ends, lambda ends: F.transform(ends, lambda end, k: run(end, F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 1)))))

    alone = F.transform(lines, lambda x: both(x, F.when(F.lit(False), x)))
    return t.let(able, lambda able: F.when(F.exists(able, lambda x: x), paired(able)).otherwise(alone))


def _under(own: Column, more: Column) -> Column:
    """Words of a row (place, x0, x1, text) with the texts of `more`: each goes to the first word whose right middle is beyond, else to the last one."""
    edge = lambda i: (F.get(own, i)["x1"] + F.get(own, i + 1)["x0"]) / 2
    edges = F.transform(own, lambda w, i: F.struct((i + 1).alias("place"), edge(i).alias("edge")))

    def met(edges: Column) -> Column:
        at = lambda m: F.coalesce(F.get(F.filter(edges, lambda e: m["x0"] < e["edge"]), F.lit(0))["place"], F.size(own))
        return F.transform(more, lambda m: F.struct(at(m).alias("at"), m["text"].alias("text")))

    def added(found: Column) -> Column:
        text = lambda i: F.array_join(F.transform(F.filter(found, lambda m: m["at"] == i + 1), lambda m: m["text"]), " ")
        return F.transform(own, lambda w, i: F.struct((i + 1).alias("place"), w["x0"].alias("x0"), w["x1"].alias("x1"), t.strip(F.concat_ws(" ", w["text"], text(i))).alias("text")))

    alone = F.transform(own, lambda w, i: F.struct((i + 1).alias("place"), w["x0"].alias("x0"), w["x1"].alias("x1"), t.strip(F.coalesce(w["text"], F.lit(""))).alias("text")))
    return F.when(more.isNull(), alone).otherwise(t.let(t.let(edges, met), added))


def _lines(words: Column, close: float, next_to: float) -> Column:
    """The rows of `table_rows` of a page, from all its words (top, x0, text, x1): top, words (place, x0, x1, text)."""

    def parted(words: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1)["top"] != F.get(words, i - 2)["top"]))
        line = lambda b, after: F.struct(F.get(words, b - 1)["top"].alias("top"), F.slice(words, b, F.coalesce(after, F.size(words) + 1) - b).alias("words"))
        return t.let(begins, lambda begins: F.transform(begins, lambda b, k: line(b, F.get(begins, k + 1))))

    n = lambda x: F.size(x["words"])
    few = lambda x, y: (n(x) <= 2) & (y["top"] - x["top"] < close)
    joined = lambda x, y: F.struct(x["top"].alias("top"), F.when(y.isNull(), x["words"]).otherwise(F.concat(x["words"], y["words"])).alias("words"))
    shorter = lambda x, y: (y["top"] - x["top"] < next_to) & (n(y) >= 2) & (n(y) < n(x))
    place = lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))
    across = lambda x: F.sort_array(F.transform(x["words"], lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"), w["x1"].alias("x1"))))
    # equal words at one place count once below a row
    more = lambda y: F.sort_array(F.array_distinct(F.transform(y["words"], place)))
    taken = lambda x, y: F.struct(x["top"].alias("top"), t.let(across(x), lambda own: _under(own, F.when(y.isNotNull(), more(y)))).alias("words"))
    first = t.let(t.let(F.sort_array(words), parted), lambda lines: _in_pairs(lines, few, joined))
    return t.let(first, lambda lines: _in_pairs(lines, shorter, taken))


def _by_page(words: DataFrame, by: list[str]) -> DataFrame:
    """All words of a page in an array, `words`; rows without a page or a top go."""
    known = words.where(" and ".join(f"`{c}` is not null" for c in [*by, "top"]))
    return known.groupBy(*by).agg(F.collect_list(F.struct("top", "x0", "text", "x1")).alias("words"))


def table_rows(words: DataFrame, by: list[str], close: float = 12.0, next_to: float = 20.0) -> DataFrame:
    """Words of table rows (by..., top, place, x0, x1, text): rows that belong together are one.

    A row of one or two words takes in the words of one less than `close` below it. A row takes in the texts of a shorter
    one less than `next_to` below it: each goes to the word that its left edge is under, by the middles of the gaps.
    """
    rows = _by_page(words, by).select(*by, F.explode_outer(_lines(F.col("words"), close, next_to)).alias("line"))
    return rows.select(*by, "line.top", F.explode_outer("line.words").alias("w")).select(*by, "top", "w.*")


def _longest_run(rows: Column, tolerance: float) -> Column:
    """Struct (begin, size) of the longest run of rows (arrays of column starts, three at least) that stand where its first one does."""
    start = F.struct(F.lit(None).cast("array<double>").alias("first"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(0).alias("size"))
    length = lambda s: F.when(s["first"].isNull(), 0).otherwise(s["at"] - s["begin"])
    best = lambda s: F.struct(F.when(length(s) > s["size"], s["begin"]).otherwise(s["best"]).alias("begin"), F.greatest(length(s), s["size"]).alias("size"))

    def step(s: Column, x: Column) -> Column:
        wide = F.size(x) >= 3
        apart = F.exists(F.arrays_zip(x.alias("a"), s["first"].alias("b")), lambda z: F.coalesce(F.abs(z["a"] - z["b"]) > 2 * tolerance, F.lit(False)))
        same = wide & s["first"].isNotNull() & (F.abs(F.size(x) - F.size(s["first"])) <= 1) & ~F.coalesce(apart, F.lit(True))
        begun = F.struct(F.when(wide, x).alias("first"), s["at"].alias("begin"), (s["at"] + 1).alias("at"), best(s)["begin"].alias("best"), best(s)["size"].alias("size"))
        return F.when(same, F.struct(s["first"].alias("first"), s["begin"].alias("begin"), (s["at"] + 1).alias("at"), s["best"].alias("best"), s["size"].alias("size"))).otherwise(begun)

    return F.aggregate(rows, start, step, best)


def _table(lines: Column, run: Column, tolerance: float, head: float) -> Column:
    """The rows (top, cells) of a page's table from its lines (top, starts, edges, words) and the run that it has; null without one."""
    body = F.slice(lines, run["begin"] + 1, run["size"])
    edges = F.flatten(F.transform(body, lambda x: x["edges"]))
    counted = lambda edges: F.transform(F.array_distinct(edges), lambda v: F.struct(v.cast("double").alias("value"), F.size(F.filter(edges, lambda x: x == v)).alias("n")))

    def taken(centres: Column) -> Column:
        """Tops of the rows above that lead."""
        width = F.size(centres)
        met = lambda x: F.size(F.filter(centres, lambda c: F.exists(x["edges"], lambda e: F.abs(e - c) <= tolerance)))
        able = lambda x: (F.size(x["edges"]) >= 2) & (F.size(x["edges"]) <= 2 * width) & (met(x) >= F.greatest(F.lit(3), (width * 0.6).cast("int")))
        start = F.struct(F.get(lines, run["begin"])["top"].cast("double").alias("top"), F.lit(True).alias("on"), F.array().cast("array<double>").alias("taken"))

        def climb(s: Column, x: Column) -> Column:
            top = x["top"].cast("double")
            on = s["on"] & (s["top"] - top <= head)
            return t.let(on & able(x), lambda takes: F.struct(F.when(takes, top).otherwise(s["top"]).alias("top"), on.alias("on"), F.when(takes, F.concat(s["taken"], F.array(top))).otherwise(s["taken"]).alias("taken")))

        return F.aggregate(F.reverse(F.slice(lines, 1, run["begin"])), start, climb, lambda s: s["taken"])

    def cells(words: Column, centres: Column) -> Column:
        placed = F.transform(words, lambda w: F.struct(layout.nearest(centres, w["x0"]).alias("of"), w["text"].alias("text")))
        cell = lambda found, i: t.strip(F.array_join(F.transform(F.filter(found, lambda w: w["of"] == i), lambda w: w["text"]), " "))
        return t.let(placed, lambda found: F.transform(centres, lambda _, i: cell(found, i)))

    def rows(centres: Column) -> Column:
        above = t.let(taken(centres), lambda tops: F.filter(F.slice(lines, 1, run["begin"]), lambda x: F.array_contains(tops, x["top"].cast("double"))))
        return F.transform(F.concat(above, body), lambda x: F.struct(x["top"].cast("double").alias("top"), cells(x["words"], centres).alias("cells")))

    return F.when(run["size"] >= 3, t.let(t.let(t.let(edges, counted), lambda c: layout.column_centres(c, tolerance)), rows))


def columnar_tables(words: DataFrame, by: list[str], tolerance: float = 8.0, head: float = 30.0) -> DataFrame:
    """The table without lines of each page that has one: by..., row, top, cells.

    words: by..., top, x0, x1, text. The longest run of three rows at least, of three columns at least, that stand where its
    first one does; cells by the nearest running centre; rows above with enough words over the columns lead as its header.
    """
    snapped = lambda x: F.array_sort(F.array_distinct(F.transform(x["words"], lambda w: F.bround(w["x0"] / tolerance, 0) * tolerance))).cast("array<double>")
    line = lambda x: F.struct(x["top"].alias("top"), snapped(x).alias("starts"), F.transform(x["words"], lambda w: w["x0"]).alias("edges"), x["words"].alias("words"))
    # one expression and an outer explode: from where() or an inner one, Spark infers filters that have the whole of it many times
    found = lambda lines: t.let(_longest_run(F.transform(lines, lambda x: x["starts"]), tolerance), lambda run: _table(lines, run, tolerance, head))
    made = t.let(F.transform(_lines(F.col("words"), 12.0, 20.0), line), found)
    pages = _by_page(words, by)
    return pages.select(*by, F.posexplode_outer(made).alias("row", "line")).where("row is not null").select(*by, "row", "line.top", "line.cells")
