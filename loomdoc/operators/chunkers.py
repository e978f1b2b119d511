"""Chunkers by file type: Markdown of a converted file to chunks with their place in it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators.splitting import FALLBACK, ChunkConfig, recursive_split
from loomdoc.operators.structure import exploded_lines, heading_prefix, packed_chunks, semantic_units, unit_parts

#: Columns of all chunkers: the key, position, content, and metadata as a map without nulls.
Chunker = Callable[[DataFrame, str, ChunkConfig], DataFrame]
_CHUNKERS: dict[str, Chunker] = {}


def register(*extensions: str) -> Callable[[Chunker], Chunker]:
    """Make a chunker the one for these extensions; the last registration wins."""

    def add(chunker: Chunker) -> Chunker:
        _CHUNKERS.update({e.lower(): chunker for e in extensions})
        return chunker

    return add


def chunker_for(extension: str) -> Chunker:
    """The chunker of an extension; files without one are split plainly."""
    return _CHUNKERS.get(extension.lower(), chunk_plain)


def chunk_extensions() -> list[str]:
    return sorted(_CHUNKERS)


def metadata(**values: Column) -> Column:
    """A map of the values as strings, without nulls."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _ordinal(partition: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


@register(".docx", ".doc")
def chunk_sections(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Sections at headings of any level; the heading stands before every chunk, as level 2."""
    rows = exploded_lines(documents.select(key, "source_file", "markdown"), [key, "source_file"])
    order = Window.partitionBy(key).orderBy("pos")
    heading = F.regexp_extract("line", rf"^(#{{1,6}}){t.SPACE}+(.+)$", 2)
    rows = rows.withColumn("heading", F.when(F.col("line").rlike(rf"^#{{1,6}}{t.SPACE}+.+$"), t.strip(heading)))
    rows = rows.withColumn("section", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(order))
    rows = rows.withColumn("title", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("")))
    body = rows.where("heading is null").groupBy(key, "source_file", "section", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    parts = body.select(key, "source_file", "section", "title", F.posexplode(recursive_split(F.col("text"), config.chunk_size, config.overlap)).alias("part", "piece"))
    numbered = parts.withColumn("chunk", _ordinal([key], "section", "part"))
    content = F.when(F.col("title") != "", F.concat(F.lit("## "), "title", F.lit("\n\n"), "piece")).otherwise(F.col("piece"))
    return numbered.select(key, "chunk", content.alias("content"), metadata(source_file=F.col("source_file"), section=F.col("title"), chunk_id=F.col("chunk")).alias("metadata"))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown row; an escaped pipe is part of a cell."""
    bare = F.regexp_replace(t.strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(t.strip(c), F.lit("\\|"), F.lit("|")))


@register(".xlsx", ".xlsm", ".xls")
def chunk_rows(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A chunk per row of each sheet's tables, as `header: value` pairs; rows are numbered from 2 as in the sheet."""
    rows = exploded_lines(documents.select(key, "source_file", "markdown"), [key, "source_file"])
    order = Window.partitionBy(key).orderBy("pos")
    name = rf"(?i)^##{t.SPACE}+Sheet:{t.SPACE}*(.+)$"
    rows = rows.withColumn("line", F.regexp_replace("line", f"{t.SPACE}+$", ""))
    rows = rows.withColumn("name", F.when(F.col("line").rlike(name), t.strip(F.regexp_extract("line", name, 1))))
    rows = rows.withColumn("sheet", F.last("name", ignorenulls=True).over(order)).withColumn("table", t.is_table_line(F.col("line")))
    rows = rows.withColumn("begins", (F.col("table") & ~F.coalesce(F.lag("table").over(order), F.lit(False))).cast("int")).withColumn("island", F.sum("begins").over(order))
    rows = rows.where("table and coalesce(sheet, '') <> ''").withColumn("cells", table_cells(F.col("line")))
    inside = Window.partitionBy(key, "island").orderBy("pos")
    rows = rows.withColumn("at", F.row_number().over(inside)).withColumn("header", F.first("cells").over(inside)).where(F.col("at") > 2)
    values = F.transform(F.col("header"), lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))
    rows = rows.withColumn("values", values).where(F.exists("values", lambda v: v != ""))
    pairs = F.zip_with("header", "values", lambda h, v: F.concat(F.when(h == "", "Column").otherwise(h), F.lit(": "), v))
    parts = rows.withColumn("row", F.col("at") - 1).select(key, "source_file", "sheet", "pos", "row", F.array_join(pairs, " | ").alias("line"))
    # a row that fits stays as it is, with the space after an empty last cell
    pieces = F.when(t.token_count(F.col("line")) <= config.chunk_size, F.array("line")).otherwise(recursive_split(F.col("line"), config.chunk_size, config.overlap))
    parts = parts.select(key, "source_file", "sheet", "pos", "row", F.posexplode(pieces).alias("part", "content"))
    return parts.select(key, _ordinal([key], "pos", "part").alias("chunk"), "content", metadata(source_file=F.col("source_file"), sheet=F.col("sheet"), row=F.col("row")).alias("metadata"))


@register(".pptx")
def chunk_slides(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Slides between `---` lines, numbered without the empty ones; the title stands before every part."""
    front = r"(?s)\A---\s*\r?\n.*?\r?\n---\s*(?:\r?\n|$)"
    content = t.strip(F.regexp_replace("markdown", front, ""))
    slides = F.filter(F.transform(F.split(content, r"(?m)^\s*---\s*$"), t.strip), lambda s: s != "")
    rows = documents.select(key, "source_file", F.posexplode(slides).alias("slide", "text")).withColumn("slide", F.col("slide") + 1)
    # the first title line goes from the body
    lines = t.lines(F.col("text"))
    title = rf"^##{t.SPACE}+(.*[^\s\x1c-\x1f\x85\p{{Z}}]){t.SPACE}*$"
    at = F.array_position(F.transform("lines", lambda x: x.rlike(title)), True).cast("int")
    rows = rows.withColumn("lines", lines).withColumn("at", at)
    rows = rows.withColumn("title", F.when(F.col("at") > 0, F.regexp_extract(F.get("lines", F.col("at") - 1), title, 1)).otherwise("[Untitled Slide]"))
    rest = t.strip(F.array_join(F.filter("lines", lambda x, i: i + 1 != F.col("at")), "\n"))
    rows = rows.withColumn("body", F.when(F.col("at") > 0, rest).otherwise(F.col("text"))).withColumn("head", F.concat(F.lit("## "), "title"))
    whole = F.concat("head", F.lit("\n\n"), "body")
    size = F.greatest(F.lit(50), config.chunk_size - t.token_count(F.col("head")) - 5)
    parts = recursive_split(F.col("body"), F.col("size"), F.least(F.lit(config.overlap), F.floor(F.col("size") / 3).cast("int")))
    chunks = F.when(F.col("body") == "", F.array("head")).when(t.token_count(whole) <= config.chunk_size, F.array(whole)).otherwise(F.transform(parts, lambda p: F.concat(F.col("head"), F.lit("\n\n"), p)))
    rows = rows.withColumn("size", size).select(key, "source_file", "slide", "title", F.posexplode(chunks).alias("part", "content")).withColumn("part", F.col("part") + 1)
    numbered = rows.withColumn("chunk", _ordinal([key], "slide", "part"))
    return numbered.select(key, "chunk", "content", metadata(source_file=F.col("source_file"), page_number=F.col("slide"), slide_number=F.col("slide"), slide_title=F.col("title"), chunk_id=F.col("chunk"), chunk_part=F.col("part")).alias("metadata"))


def page_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines between page markers: key, source_file, pos, line, first (the page's first position), page_number (null before the first)."""
    rows = exploded_lines(documents.select(key, "source_file", "markdown"), [key, "source_file"])
    order = Window.partitionBy(key).orderBy("pos")
    marker = rf"(?i)^{t.SPACE}*<!--{t.SPACE}*page:{t.SPACE}*(\d+){t.SPACE}*-->{t.SPACE}*$"
    rows = rows.withColumn("marker", F.when(F.col("line").rlike(marker), F.regexp_extract("line", marker, 1).cast("int")))
    rows = rows.withColumn("page_number", F.last("marker", ignorenulls=True).over(order))
    begins = F.when(F.col("marker").isNotNull() | (F.col("pos") == 0), F.col("pos") + F.col("marker").isNotNull().cast("int"))
    return rows.withColumn("first", F.last(begins, ignorenulls=True).over(order)).where("marker is null").drop("marker")


def pages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages between page markers: key, source_file, first (position), page_number (null before the first marker), content."""
    text = t.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"))
    found = page_lines(documents, key).groupBy(key, "source_file", "first", "page_number").agg(text.alias("content"))
    return found.where("content <> ''").select(key, "source_file", "first", "page_number", "content")


@register(".pdf")
def chunk_pages(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Each page by itself: units packed under headings, repeated chunks of a page dropped before they are numbered."""
    return chunk_page_units(page_units(documents, key), key, config)


def page_units(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units of each page, whatever the configuration of the chunks."""
    return semantic_units(page_lines(documents, key), [key, "source_file", "first", "page_number"])


def page_chunks(units: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig(), apart: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of pages, not numbered, without those that a page has again: key, source_file, first, page_number, chunk, content and more.

    Where units have columns `apart`, as their configuration, chunks are packed and compared within equal values of them.
    Nothing is dealt anew where the units are dealt by the key.
    """
    chunks = packed_chunks(unit_parts(units, config), [key, "source_file", "first", "page_number", *apart], config)
    same = F.row_number().over(Window.partitionBy(key, "page_number", *apart, t.casefold(t.collapse(F.col("content")))).orderBy("first", "chunk"))
    return chunks.withColumn("same", same).where("same = 1").drop("same")


def chunk_page_units(units: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of pages from their units."""
    kept = page_chunks(units, key, config)
    kept = kept.withColumn("number", _ordinal([key], "first", "chunk")).withColumn("part", _ordinal([key, "first"], "chunk"))
    parent = F.concat(F.lit("page:"), F.coalesce("page_number", F.lit(0)).cast("string"), F.lit(":"), F.left(F.sha1(t.casefold(F.col("heading_path")).cast("binary")), F.lit(12)))
    values = {"source_file": F.col("source_file"), "chunk_id": F.col("number"), "chunk_part": F.col("part"), **_unit_values(), "page_number": F.col("page_number"), "parent_id": parent, "child_index": F.col("part")}
    return kept.select(key, F.col("number").alias("chunk"), "content", metadata(**values).alias("metadata"))


def _unit_values() -> dict[str, Column]:
    names = ("indexable", "image_path", "image_alt", "ocr_engine", "ocr_confidence", "ocr_regions", "bbox")
    return {n: F.col(f"unit.{n}") for n in names} | {"block_type": F.col("block_type"), "heading_path": F.col("heading_path")}


@register(".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp", ".gif")
def chunk_image(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Texts that recognition found in an image; an image without text has no chunk."""
    by = [key, "source_file"]
    units = semantic_units(exploded_lines(documents, by), by)
    chunks = packed_chunks(unit_parts(units, config), by, config).withColumn("number", _ordinal([key], "chunk"))
    values = {"source_file": F.col("source_file"), "chunk_id": F.col("number"), "chunk_part": F.col("number"), "image_number": F.lit(1), "source_extension": t.extension(F.col("source_file")), **_unit_values()}
    return chunks.select(key, F.col("number").alias("chunk"), "content", metadata(**values).alias("metadata"))


def chunk_plain(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = FALLBACK) -> DataFrame:
    """Files without a chunker of their own."""
    parts = documents.select(key, "source_file", F.posexplode(recursive_split(F.col("markdown"), config.chunk_size, config.overlap)).alias("at", "content"))
    return parts.select(key, (F.col("at") + 1).alias("chunk"), "content", metadata(source_file=F.col("source_file")).alias("metadata"))


def chunk_documents(documents: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig(), strict: bool = False) -> DataFrame:
    """Chunks of documents (key, source_file, markdown) by extension.

    Others than the registered extensions, and documents without a file name, are split plainly, or with `strict` make the
    query fail, as an upload does. Extensions that no row has aren't planned; each other branch reads `documents` again: give
    a written table where it is dear.
    """
    rows = documents.withColumn("ext", F.coalesce(t.extension(F.col("source_file")), F.lit("")))
    known = F.when(F.col("ext").isin(chunk_extensions()), F.col("ext")).otherwise("")
    present = {r[0] for r in rows.select(known).distinct().collect()}  # a few, whatever the rows
    groups: dict[Chunker, list[str]] = {}
    for ext, chunker in _CHUNKERS.items():
        if ext in present:
            groups.setdefault(chunker, []).append(ext)
    done = [chunker(rows.where(F.col("ext").isin(exts)), key, config) for chunker, exts in groups.items()]
    if "" not in present and done:
        return reduce(DataFrame.unionByName, done)
    rest = rows.where(~F.col("ext").isin(chunk_extensions()))
    if strict:
        known = ", ".join(chunk_extensions())
        rest = rest.withColumn("markdown", F.raise_error(F.concat(F.lit("unsupported extension "), "ext", F.lit(f"; supported: {known}"))).cast("string"))
    return reduce(DataFrame.unionByName, [*done, chunk_plain(rest, key)])


__all__ = ["chunk_documents", "chunk_extensions", "chunk_image", "chunk_page_units", "chunk_pages", "chunk_plain", "chunk_rows", "chunk_sections", "chunk_slides", "chunker_for", "heading_prefix", "metadata", "page_chunks", "page_units", "pages", "register", "table_cells"]
