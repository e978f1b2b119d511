"""Page layout: boxes, lines, columns, headings, margins, tables; rows in, rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.session import stored

#: Glyph numbers and private-use characters of common PDF fonts, and list marks.
GLYPHS = {"1": "°", "2": "±", "3": "−", "4": "×", "5": "µ", "6": "·", "7": "→", "8": "←", "9": "↑", "10": "↓", "14": "•", "15": "·", "16": "™", "17": "©", "18": "®", "25": "°", "30": "Ω", "32": "·"}
PRIVATE, PLAIN = "", "():"
LIST_MARK = r"^(?:[-*•●] |\d+[.|)])"
STEPS = r"^(?:BƯỚC|BUOC|Step)"


def repaired(text: Column) -> Column:
    """Text of a PDF without glyph numbers, private-use brackets and invisible spaces; degrees restored."""
    out = reduce(lambda x, g: F.replace(x, F.lit(f"(cid:{g[0]})"), F.lit(g[1])), GLYPHS.items(), text)
    out = F.translate(F.regexp_replace(out, r"\(cid:\d+\)", ""), PRIVATE + "​﻿»«", PLAIN + "  ≈≈")
    out = F.regexp_replace(out, r"(\d)\s+C\b", "$1°C")
    out = F.regexp_replace(out, r"(–\d+)\s*C\b", "$1°C")
    return F.regexp_replace(out, r"\bC\b(?=\s*/\s*W)", "°C")


def heading_like(text: Column) -> Column:
    """Whether the first letter or digit is an upper-case letter or a digit."""
    return F.regexp_extract(text, r"([\p{L}\p{N}])", 1).rlike(r"[\p{Lu}\p{N}]")


def block_type(text: Column, size: Column, font: Column, usual_size: Column, largest: Column, usual_font: Column, bold_fonts: Column) -> Column:
    """h1, h2, list_item or paragraph by list mark, font size and weight."""
    bare = t.strip(text)
    bold = (font != "") & (font != usual_font) & (F.coalesce(F.array_contains(bold_fonts, font), F.lit(False)) | F.lower(font).contains("bold"))
    return (
        F.when(bare == "", "paragraph")
        .when(bare.rlike(LIST_MARK), "list_item")
        .when(size > usual_size + 0.4, F.when(size >= largest - 0.5, "h1").otherwise("h2"))
        .when(bold & bare.rlike(STEPS), "h2")
        .when(bold & heading_like(bare), F.when(F.size(t.words(bare)) <= 10, "h1").otherwise("h2"))
        .otherwise("paragraph")
    )


def block_type_scanned(text: Column, height: Column, usual: Column, largest: Column) -> Column:
    """The same for recognised lines: by height, step words and capitals."""
    bare, n = t.strip(text), F.size(t.words(text))
    capitals = (F.upper(bare) == bare) & bare.rlike("[A-ZÀ-Ỷ]") & (n <= 10)
    return (
        F.when(bare == "", "paragraph")
        .when(bare.rlike(LIST_MARK), "list_item")
        .when(height > usual + 0.5, F.when(height >= largest - 0.5, "h1").otherwise("h2"))
        .when(bare.rlike(STEPS), "h2")
        .when(capitals, F.when(n <= 5, "h1").otherwise("h2"))
        .otherwise("paragraph")
    )


def font_mode(spans: DataFrame, by: list[str]) -> DataFrame:
    """Most used font size, by visible characters, in half points (the smallest of equals), and the largest. spans: size, text."""
    rows = spans.select(*by, t.half_points(F.col("size")).alias("half"), F.length(t.squeezed(F.col("text"))).alias("n")).where("n > 0")
    sums = rows.groupBy(*by, "half").agg(F.sum("n").alias("n"))
    return sums.groupBy(*by).agg(F.max_by("half", F.struct("n", -F.col("half"))).alias("most_used"), F.max("half").alias("largest"))


HOT = 4096  # a group with more than one in HOT of all values is counted, not sorted: there are at most as many of them
BUCKETS, PASSES = 4096, 2


def upper_median(values: DataFrame, by: list[str], column: str, hot: int = HOT) -> DataFrame:
    """The value at rank floor(n / 2) from 0; nulls don't count.

    Small groups are ranked by a window. A group with more than one in `hot` of all values is never sorted: its range is cut
    into BUCKETS equal ones, the counts tell in which the rank falls, and that one is cut again, PASSES times; the distinct
    values of the last bucket, with their counts, are all that is ranked. Partial counts meet before every shuffle.
    """
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"))
    counts = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "medians")
    total = counts.agg(F.sum("n")).first()[0] or 0
    same = lambda other: reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by])
    large = F.col("n") > total // hot
    w = Window.partitionBy(*by)
    cold = rows.alias("v").join(counts.where(~large).alias("c"), same("c")).select("v.*", "n").withColumn("at", F.row_number().over(w.orderBy("value")))
    out = cold.where(F.col("at") == F.floor(F.col("n") / 2) + 1).select(*by, F.col("value").alias("upper_median"))
    span = counts.where(large).select(*by, F.floor(F.col("n") / 2).alias("rank"), "low", "high")
    if not span.limit(1).count():
        return out
    for _ in range(PASSES):
        # the bucket rises with the value, so that counts of buckets are counts of ranks
        place = F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") - F.col("low")).cast("double") / F.greatest((F.col("high") - F.col("low")).cast("double"), F.lit(1e-300)) * BUCKETS)).cast("int")
        inside = rows.alias("v").join(F.broadcast(span).alias("s"), same("s") & F.col("v.value").between(F.col("s.low"), F.col("s.high"))).select("v.*", "rank", "low", "high")
        held = inside.groupBy(*by, "rank", place.alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.sum("n").over(w.orderBy("bucket")) - F.col("n")  # a row per bucket
        hit = held.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        span = stored(hit.select(*by, (F.col("rank") - F.col("before")).alias("rank"), "low", "high"), "medians")
    inside = rows.alias("v").join(F.broadcast(span).alias("s"), same("s") & F.col("v.value").between(F.col("s.low"), F.col("s.high"))).select("v.*", "rank")
    held = inside.groupBy(*by, "rank", "value").agg(F.count("*").alias("n"))
    before = F.sum("n").over(w.orderBy("value")) - F.col("n")
    hit = held.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return out.unionByName(hit.select(*by, F.col("value").alias("upper_median")))


def repeated_margins(blocks: DataFrame, doc: str, page: str, least_pages: int = 3, share: float = 0.6, longest: int = 160) -> DataFrame:
    """Blocks without the short ones that stand first or last on most pages. blocks: doc, page, y1, x1, content."""
    w = Window.partitionBy(doc, page)
    # folding never shortens a text, so that only short ones are folded
    key = t.let(t.collapse(F.col("content")), lambda x: F.when(F.length(x) <= longest, t.casefold(x)))
    rows = blocks.withColumn("key", key).withColumn("up", F.row_number().over(w.orderBy("y1", "x1"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("y1"), F.desc("x1"))))
    margin = rows.where(((F.col("up") <= 2) | (F.col("down") <= 2)) & (F.col("key") != "") & (F.length("key") <= longest)).select(doc, page, "key").distinct()
    total = blocks.where(F.col(page).isNotNull()).groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    often = margin.groupBy(doc, "key").agg(F.count_distinct(page).alias("n")).join(total, doc).where((F.col("pages") >= least_pages) & (F.col("n") >= F.greatest(F.lit(least_pages), (F.col("pages") * share + 0.999).cast("int"))))
    # a page's own, so that blocks are joined where their windows left them
    gone = margin.join(often.select(doc, "key"), [doc, "key"]).groupBy(doc, page).agg(F.collect_set("key").alias("gone"))
    return rows.join(gone, [doc, page], "left").where(~F.coalesce(F.array_contains("gone", F.col("key")), F.lit(False))).select(*blocks.columns)


def bands(intervals: DataFrame, by: list[str], gap: float = 3.0) -> DataFrame:
    """Intervals (y1, y2) merged where they overlap or are at most `gap` apart: by..., band, y1, y2, n."""
    before = Window.partitionBy(*by).orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("y1", "y2")
    rows = intervals.withColumn("reach", F.max("y2").over(before))
    rows = rows.withColumn("band", F.sum(F.when(F.col("reach").isNull() | (F.col("y1") - F.col("reach") > gap), 1).otherwise(0)).over(order))
    return rows.groupBy(*by, "band").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def gaps_between(merged: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """The free spaces between bands that are taller than `least`."""
    order = Window.partitionBy(*by).orderBy("y1")
    return merged.withColumn("next", F.lead("y1").over(order)).where(F.col("next") - F.col("y2") > least).select(*by, F.col("y2").alias("y1"), F.col("next").alias("y2"))


def column_gap(chars: DataFrame, by: list[str], width: str = "page_width", bucket: float = 3.0, least: float = 15.0) -> DataFrame:
    """The middle of the widest empty stretch in the page's middle, where text parts into two columns. chars: by..., x0, page_width."""
    inside = chars.where((F.col("x0") >= F.col(width) * 0.08) & (F.col("x0") <= F.col(width) * 0.92)).select(*by, width, F.floor(F.col("x0") / bucket).cast("int").alias("b")).distinct()
    order = Window.partitionBy(*by).orderBy("b")
    first = F.floor(F.col(width) * 0.08 / bucket).cast("int")
    rows = inside.withColumn("start", F.coalesce(F.lag("b").over(order) + 1, first))
    rows = rows.withColumn("gap", (F.col("b") - F.col("start")) * bucket).withColumn("center", (F.col("b") + F.col("start")) / 2 * bucket)
    rows = rows.where((F.col("gap") > least) & (F.col("center") > F.col(width) * 0.3) & (F.col("center") < F.col(width) * 0.7))
    return rows.groupBy(*by).agg(F.max_by("center", F.struct("gap", -F.col("center"))).alias("center"), F.max("gap").alias("gap"))


def gap_groups(words: DataFrame, by: list[str], limit: Column) -> DataFrame:
    """Words of a line parted where the gap to the farthest end so far is over the limit. words: x0, x1, top, bottom, text."""
    order = Window.partitionBy(*by).orderBy("x0", "x1")
    rows = words.withColumn("reach", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("group", F.sum(F.when(F.col("x0") - F.col("reach") > limit, 1).otherwise(0)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*by, "group").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), text.alias("text"))


def reading_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks with `position`: page, then given order, then rounded top and left. blocks: page_number, reading_order, y1, x1."""
    given = F.col("reading_order").isNotNull()
    keys = [F.coalesce("page_number", F.lit(0)), F.coalesce("reading_order", F.lit(10**9)), F.when(given, 0.0).otherwise(F.bround("y1", 1)), F.when(given, 0.0).otherwise(F.col("x1"))]
    return blocks.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*keys, "block_id")))


def column_centres(starts: Column, tolerance: float) -> Column:
    """Running centres of sorted starts (value, n): one within the tolerance moves the last centre half way to it, n times.

    A value that comes n times is one item: n halvings are a power of two.
    """
    nothing = F.array().cast("array<double>")
    start = F.struct(nothing.alias("done"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, x: Column) -> Column:
        new = s["last"].isNull() | (x["value"] - s["last"] > tolerance)
        moved = x["value"] + (s["last"] - x["value"]) * F.pow(F.lit(0.5), x["n"])
        done = F.when(new & s["last"].isNotNull(), F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(new, x["value"]).otherwise(moved).alias("last"))

    return F.aggregate(F.array_sort(starts), start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def nearest(centres: Column, x: Column) -> Column:
    """The index of the nearest centre, from 0; the first of equals."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]


def markdown_table(header: Column, rows: Column) -> Column:
    """A Markdown table: line ends as spaces, pipes escaped, rows as wide as the header."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fitted = lambda r: F.transform(header, lambda _, i: cell(F.get(r, i)))
    body = F.transform(rows, lambda r: line(fitted(r)))
    return F.array_join(F.concat(F.array(line(F.transform(header, cell)), line(F.transform(header, lambda _: F.lit("---")))), body), "\n")


def compiled(blocks: DataFrame, *by: str) -> DataFrame:
    """Markdown of a document, or of what else the keys `by` name, from its blocks in order: page markers, headings, list items, tables, images, text.

    blocks: position, page_number, block_type, content; images may have ocr_text, ocr_confidence, ocr_engine, ocr_regions
    and a box x1, y1, x2, y2. An image with a recognised text has it in a quoted block, another one its path.
    """
    kinds = {"ocr_text": "string", "ocr_confidence": "double", "ocr_engine": "string", "ocr_regions": "int", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}
    rows = blocks.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in blocks.columns})
    text = repaired(t.strip(F.coalesce("content", F.lit(""))))
    own = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    box = F.format_string("%.1f,%.1f,%.1f,%.1f", *[F.coalesce(c, F.lit(0.0)) for c in ("x1", "y1", "x2", "y2")])
    engine = F.when(F.coalesce("ocr_engine", F.lit("")) == "", "unknown").otherwise(F.col("ocr_engine"))
    count = F.when(F.coalesce("ocr_regions", F.lit(0)) == 0, 1).otherwise(F.col("ocr_regions"))
    data = own("<!-- ocr-meta: engine=", engine, "; confidence=", F.format_string("%.4f", "ocr_confidence"), "; regions=", count.cast("string"), "; bbox=", box, " -->\n")
    known = F.when(F.col("ocr_confidence").isNotNull(), data).otherwise("")
    seen = own("\n<img>\n", known, '"""\n', F.col("ocr_text"), '\n"""\n')
    image = F.when(F.coalesce("ocr_text", F.lit("")) != "", seen).when(text != "", own("\n<img> ", text, "\n")).otherwise("\n<img>\n")
    item = F.when(text.rlike(r"^[-*•●]\s+"), own("* ", t.strip(F.substring(text, 3, 1 << 30)), "\n")).when(text.rlike(r"^\d+[.|)]"), own(text, "\n")).otherwise(own("* ", text, "\n"))
    kind = F.col("block_type")
    line = (
        F.when(kind == "image", image).when(text == "", "").when(kind == "h1", own("\n# ", text, "\n")).when(kind == "h2", own("\n## ", text, "\n"))
        .when(kind == "list_item", item).when(kind == "table", own("\n", text, "\n")).otherwise(own(text, "\n"))
    )
    before = F.last("page_number", ignorenulls=True).over(Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    turned = F.col("page_number").isNotNull() & ~F.coalesce(before == F.col("page_number"), F.lit(False))
    marked = rows.select(*by, "position", F.when(turned, own("\n<!-- page: ", F.col("page_number").cast("string"), " -->\n", line)).otherwise(line).alias("line"))
    return marked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "").alias("markdown"))


# Orders that depend on what was ordered before: large parts by windows, the small parts that are left by one fold each.


def _ends_at(boxes: Column, start: str, end: str) -> Column:
    """Where, from 1, the sorted boxes part: at the first, and at each that starts where nothing before it reaches beyond."""
    state = F.struct(F.lit(None).cast("double").alias("reach"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        free = s["reach"].isNull() | (x[start] >= s["reach"])
        cuts = F.when(free, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"])
        return F.struct(F.greatest(s["reach"], x[end]).alias("reach"), (s["at"] + 1).alias("at"), cuts.alias("cuts"))

    return F.aggregate(boxes, state, step, lambda s: s["cuts"])


def _cut_at(boxes: Column, cuts: Column) -> Column:
    """The boxes in runs that begin at the cuts."""
    after = lambda i: F.coalesce(F.get(cuts, i + 1), F.size(boxes) + 1)
    return F.transform(cuts, lambda c, i: F.slice(boxes, c, after(i) - c))


def _sorted(boxes: Column, *by: str) -> Column:
    place = lambda x: F.struct(*[x[c] for c in by])
    return F.array_sort(boxes, lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))


def _parts(some: Column) -> Column:
    """A part's parts: at free rows all of them, else two at the first free column, else itself."""
    down, across = _sorted(some, "y1", "x1", "id"), _sorted(some, "x1", "id")
    columns = lambda x: t.let(F.slice(_ends_at(x, "x1", "x2"), 1, 2), lambda cuts: _cut_at(x, cuts))
    rows = lambda x: t.let(_ends_at(x, "y1", "y2"), lambda cuts: F.when(F.size(cuts) > 1, _cut_at(x, cuts)).otherwise(t.let(across, columns)))
    return t.let(down, rows)


def cut_order(boxes: Column) -> Column:
    """XY-cut of an array of boxes (y1, x1, id, y2, x2 and more): free rows part them, else a free column, else top-left order.

    A stack of parts; each step takes the first one and puts back its parts, or lays it down where it has none. n boxes make
    less than 2 n parts.
    """
    nothing = F.slice(boxes, 1, 0)
    start = F.struct(F.array(boxes).alias("todo"), nothing.alias("out"))

    def step(s: Column, _: Column) -> Column:
        rest = F.slice(s["todo"], 2, F.size(s["todo"]))
        leaf = F.struct(rest.alias("todo"), F.concat(s["out"], _sorted(s["todo"][0], "y1", "x1", "id")).alias("out"))
        parted = lambda p: F.when(F.size(p) > 1, F.struct(F.concat(p, rest).alias("todo"), s["out"].alias("out"))).otherwise(leaf)
        return F.when(F.size(s["todo"]) == 0, s).when(F.size(s["todo"][0]) < 2, leaf).otherwise(t.let(_parts(s["todo"][0]), parted))

    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(boxes)), start, step, lambda s: s["out"])


def _islands(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Rows with `island` (from 0): which run of overlapping intervals of their part they are in, and `islands`, how many there are."""
    part = Window.partitionBy(*by)
    order = part.orderBy(start, "id")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col(start) >= F.col("reach"), 1).otherwise(0)).over(order))
    return found.withColumn("islands", F.max("island").over(part) + 1).drop("reach")


def xy_cut(shapes: DataFrame, by: str, most: int = 128) -> DataFrame:
    """Shapes of a slide with `position` in reading order. shapes: by, shape_id, x1, y1, x2, y2.

    Slides of more than `most` shapes are parted level by level: windows find the islands of every large part, whose place
    joins its path, until a part is small or has neither free row nor column. Each small part is then one fold over at most
    `most` boxes. Equal places go by shape_id.
    """
    own = [c for c in shapes.columns if c != "position"]
    boxes = shapes.select(F.col(by).alias("slide"), F.col("shape_id").alias("id"), *[F.col(c).cast("double") for c in ("y1", "x1", "y2", "x2")], F.lit("").alias("path"), F.struct(*own).alias("shape"))
    key = ["slide", "path"]
    size = F.count("*").over(Window.partitionBy(*key))
    small, whole = [], None
    rows = boxes.withColumn("n", size)
    if rows.where(F.col("n") > most).limit(1).count():
        level = stored(rows, "xy-cut")
        whole = []
        while level.where(F.col("n") > most).limit(1).count():
            small.append(level.where(F.col("n") <= most).drop("n"))
            large = _islands(level.where(F.col("n") > most).drop("n"), key, "y1", "y2").withColumnsRenamed({"island": "row", "islands": "rows"})
            large = stored(_islands(large, key, "x1", "x2"), "xy-cut")
            leaf = (F.col("rows") == 1) & (F.col("islands") == 1)
            whole.append(large.where(leaf).select(*boxes.columns))
            number = F.when(F.col("rows") > 1, F.col("row")).otherwise(F.least(F.col("island"), F.lit(1)))
            parted = large.where(~leaf).withColumn("path", F.concat("path", F.lpad(F.hex(number), 8, "0"))).select(*boxes.columns)
            level = stored(parted.withColumn("n", size), "xy-cut")
        small.append(level.drop("n"))
        rows = reduce(DataFrame.unionByName, small)
    parts = rows.groupBy(*key).agg(F.collect_list(F.struct("y1", "x1", "id", "y2", "x2", "shape")).alias("boxes"))
    placed = parts.select(*key, F.posexplode(cut_order(F.col("boxes"))).alias("at", "box")).select(*key, "at", F.col("box.shape").alias("shape"))
    if whole:
        order = F.row_number().over(Window.partitionBy(*key).orderBy("y1", "x1", "id")) - 1
        placed = placed.unionByName(reduce(DataFrame.unionByName, whole).select(*key, order.alias("at"), "shape"))
    if whole is None:
        position = F.col("at")
    else:
        position = F.row_number().over(Window.partitionBy("slide").orderBy("path", "at")) - 1
    return placed.select("shape", position.cast("long").alias("position")).select("shape.*", "position")


def word_lines(words: DataFrame, by: str) -> DataFrame:
    """Words with `line`: the first line whose moving centre is within max(3, 0.55 upper median height). words: word_id, top, bottom, x0.

    Words go by top, x0 and word_id. Where all centres that follow are further below all before than that, no line goes on; between
    such places few words are left, and one fold finds the lines that are open among them.
    """
    height = F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))
    place = [F.col(by).alias("page"), F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("word_id").alias("key")]
    rows = words.select(*place, height.alias("height"), ((F.col("top") + F.col("bottom")) / 2).alias("centre"), F.struct(*words.columns).alias("word"))
    usual = upper_median(rows, ["page"], "height").select(F.col("page").alias("of"), F.col("upper_median").alias("median_height"))
    rows = rows.join(usual, F.col("page").eqNullSafe(F.col("of"))).withColumn("near", F.greatest(F.lit(3.0), F.col("median_height") * 0.55))
    order = Window.partitionBy("page").orderBy("top", "x0", "key")
    before, after = F.max("centre").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.min("centre").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after)
    rows = rows.withColumn("part", F.sum(F.when(F.col("after") - F.col("before") <= F.col("near"), 0).otherwise(1)).over(order))
    parts = rows.groupBy("page", "part", "median_height", "near").agg(_sorted(F.collect_list(F.struct("top", "x0", "key", "centre", "word")), "top", "x0", "key").alias("words"))
    start = F.struct(F.array().cast("array<struct<sum:double,n:int>>").alias("lines"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, w: Column) -> Column:
        close = F.transform(s["lines"], lambda x, i: F.when(F.abs(w["centre"] - x["sum"] / x["n"]) <= F.col("near"), i))
        one = F.struct(w["centre"].alias("sum"), F.lit(1).alias("n"))

        def put(at: Column) -> Column:
            more = F.transform(s["lines"], lambda x, i: F.when(i == at, F.struct((x["sum"] + w["centre"]).alias("sum"), (x["n"] + 1).alias("n"))).otherwise(x))
            lines = F.when(at < F.size(s["lines"]), more).otherwise(F.concat(s["lines"], F.array(one)))
            return F.struct(lines.alias("lines"), F.concat(s["found"], F.array(at)).alias("found"))

        return t.let(F.coalesce(F.array_min(close), F.size(s["lines"])), put)

    lined = parts.withColumn("made", F.aggregate("words", start, step))
    lined = lined.select("page", "part", "median_height", "made", F.posexplode("words").alias("at", "w"))
    number = F.element_at("made.found", F.col("at") + 1)
    line = F.element_at("made.lines", number + 1)
    lined = lined.select("page", "part", "median_height", F.col("w.word").alias("word"), number.alias("number"), (line["sum"] / line["n"]).alias("mean"))
    rank = F.dense_rank().over(Window.partitionBy("page").orderBy("mean", "part", "number")) - 1
    return lined.select("word", rank.cast("long").alias("line"), "median_height").select("word.*", "line", "median_height")


def regions(words: DataFrame, by: str) -> DataFrame:
    """Recognised words to regions: lines, parted at wide gaps; two columns are read one after the other.

    A page has two columns where the largest gap between sorted left edges is a quarter of the page's width and two regions
    at least stand on either side; regions over the middle lead or trail.
    """
    clean = words.where(t.strip(F.col("text")) != "")
    lined = word_lines(clean, by)
    grouped = gap_groups(lined, [by, "line", "median_height"], F.greatest(F.lit(40.0), F.col("median_height") * 4))
    page, by_x = Window.partitionBy(by), Window.partitionBy(by).orderBy("x0", "top", "group")
    rows = grouped.withColumn("n", F.count("*").over(page)).withColumn("width", F.greatest(F.lit(1.0), F.max("x1").over(page) - F.min("x0").over(page)))
    rows = rows.withColumn("at", F.row_number().over(by_x)).withColumn("next", F.lead("x0").over(by_x)).withColumn("gap", F.col("next") - F.col("x0"))
    # of equal gaps the last one, as the largest pair of gap and place
    rows = rows.withColumn("best", F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", "at", ((F.col("x0") + F.col("next")) / 2).alias("divider")))).over(page))
    divider = F.col("best.divider")
    split = (F.col("n") >= 4) & (F.col("best.gap") >= F.col("width") * 0.25) & (F.col("best.at") >= 2) & (F.col("n") - F.col("best.at") >= 2)
    spanning = (F.col("x0") < divider) & (divider < F.col("x1"))
    side = F.when(spanning, 1).when((F.col("x0") + F.col("x1")) / 2 < divider, 2).otherwise(3)
    rows = rows.withColumn("side", side)
    rows = rows.withColumn("two", F.coalesce(split & (F.count_if(F.col("side") == 2).over(page) >= 2) & (F.count_if(F.col("side") == 3).over(page) >= 2), F.lit(False)))
    rows = rows.withColumn("top_of", F.min(F.when(F.col("side") > 1, F.col("top"))).over(page))
    place = F.when(~F.col("two"), 0).when((F.col("side") == 1) & (F.col("top") > F.col("top_of")), 4).otherwise(F.col("side"))
    rows = rows.withColumn("place", place)
    return rows.select(by, F.row_number().over(Window.partitionBy(by).orderBy("place", "top", "x0")).alias("position"), "x0", "top", "x1", "bottom", "text")
