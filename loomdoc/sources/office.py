"""Files to Markdown: formats by extension, office files read with the standard library, identity by SHA-256."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.functions import text as t

#: A converter gets a file's bytes and the stem of its name, and gives Markdown.
Converter = Callable[[bytes, str], str]
_CONVERTERS: dict[str, Converter] = {}
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp", ".gif")
LEGACY = {".doc": ".docx", ".xls": ".xlsx", ".ppt": ".pptx"}
MAX_BYTES = 25 * 1024 * 1024


class ProviderMissing(RuntimeError):
    """The format needs a provider (PDF text, recognition) that isn't set."""


def register(*extensions: str) -> Callable[[Converter], Converter]:
    """Make a converter the one for these extensions; the last registration wins."""

    def add(converter: Converter) -> Converter:
        _CONVERTERS.update({e.lower(): converter for e in extensions})
        return converter

    return add


def converter_extensions() -> list[str]:
    return sorted(_CONVERTERS)


def _names(node: ET.Element, name: str) -> Iterator[ET.Element]:
    """Elements of a local name, in whatever namespace."""
    return (e for e in node.iter() if e.tag.rpartition("}")[2] == name)


def _text(node: ET.Element, name: str = "t") -> str:
    return "".join(e.text or "" for e in _names(node, name))


def _attribute(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _relations(file: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id, as paths within the file."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in file.namelist():
        return {}
    found = _names(ET.fromstring(file.read(path)), "Relationship")
    return {r.get("Id"): posixpath.normpath(posixpath.join("" if r.get("Target", "").startswith("/") else folder, r.get("Target", "").lstrip("/"))) for r in found}


def column_index(reference: str) -> int:
    """The column of a cell name, from 0."""
    out = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        out = out * 26 + ord(c) - 64
    return out - 1


def table(rows: list[list[str]]) -> str:
    """A Markdown table as wide as its first row."""
    cell = lambda x: re.sub(r"\r?\n", " ", x or "").replace("|", "\\|")
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(cell(x) for x in [*r, *[""] * width][:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def xlsx_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Sheets of a workbook with their rows, all as wide as the widest; blank rows are left out, and sheets without any other."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        shared = [_text(si) for si in _names(ET.fromstring(file.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in file.namelist() else []
        targets = _relations(file, "xl/workbook.xml")
        for sheet in _names(ET.fromstring(file.read("xl/workbook.xml")), "sheet"):
            cells: dict[tuple[int, int], str] = {}
            for row_at, row in enumerate(_names(ET.fromstring(file.read(targets[_attribute(sheet, "id")])), "row")):
                at = -1
                for c in _names(row, "c"):
                    at = column_index(c.get("r")) if c.get("r") else at + 1
                    value = next((v.text or "" for v in _names(c, "v")), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = _text(c)
                    cells[int(row.get("r") or row_at + 1), at] = value.strip()
            width = max((c for _, c in cells), default=-1) + 1
            rows = [[cells.get((r, c), "") for c in range(width)] for r in sorted({r for r, _ in cells})]
            if rows := [r for r in rows if any(r)]:
                yield sheet.get("name") or "", rows


@register(".xlsx", ".xlsm")
def xlsx_to_markdown(data: bytes, stem: str) -> str:
    """Sheets as tables; blank rows are left out."""
    out = [f"# {stem}"]
    for name, rows in xlsx_sheets(data):
        out += [f"## Sheet: {name}", table(rows)]
    return "\n\n".join(out)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(name, text)
    return out.getvalue()


def _related(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of sheets of texts."""
    cell = lambda x: f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'
    body = lambda rows: "<worksheet><sheetData>" + "".join(f'<row r="{i}">' + "".join(map(cell, r)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    names = "".join(f'<sheet name={quoteattr(n)} r:id="r{i}"/>' for i, n in enumerate(sheets))
    parts = {"xl/workbook.xml": f'<workbook xmlns:r="r"><sheets>{names}</sheets></workbook>', "xl/_rels/workbook.xml.rels": _related({f"r{i}": f"worksheets/s{i}.xml" for i in range(len(sheets))})}
    return _zipped(parts | {f"xl/worksheets/s{i}.xml": body(rows) for i, rows in enumerate(sheets.values())})


def presentation(slides: list[tuple[str, list[str]]]) -> bytes:
    """A presentation of slides with a title and a list of texts."""
    line = lambda x: f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>"
    shape = lambda y, kind, texts: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="90" cy="10"/></a:xfrm></p:spPr><p:txBody>{"".join(map(line, texts))}</p:txBody></p:sp>'
    slide = lambda title, texts: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape(0, "<p:ph type=" + chr(34) + "title" + chr(34) + "/>", [title])}{shape(20, "", texts)}</p:spTree></p:cSld></p:sld>'
    ids = "".join(f'<sldId r:id="s{i}"/>' for i in range(len(slides)))
    parts = {"ppt/presentation.xml": f'<p xmlns:r="r">{ids}</p>', "ppt/_rels/presentation.xml.rels": _related({f"s{i}": f"slides/slide{i}.xml" for i in range(len(slides))})}
    return _zipped(parts | {f"ppt/slides/slide{i}.xml": slide(*x) for i, x in enumerate(slides)})


@register(".docx")
def docx_to_markdown(data: bytes, stem: str) -> str:
    """Headings by style, lists, tables, paragraphs, under the file's stem."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        body = next(_names(ET.fromstring(file.read("word/document.xml")), "body"))
    out = [f"# {stem}"]
    for node in body:
        kind = node.tag.rpartition("}")[2]
        if kind == "tbl":
            rows = [[" ".join(filter(None, (_text(p).strip() for p in _names(c, "p")))) for c in _names(r, "tc")] for r in _names(node, "tr")]
            if rows and rows[0]:
                out.append(table(rows))
        elif kind == "p" and (text := _text(node).strip()):
            style = next((_attribute(s, "val") for s in _names(node, "pStyle")), "")
            level = re.fullmatch(r"(?i)heading ?([1-6])", style)
            listed = next(_names(node, "numPr"), None) is not None
            out.append(("#" * int(level[1]) + " " if level else "- " if listed else "") + text)
    return "\n\n".join(out if len(out) > 1 else [*out, "_This document has no text._"])


def _parted(boxes: list[tuple], order: list[int], start: int, end: int, all_gaps: bool) -> list[list[int]]:
    """The boxes by their start on an axis, parted at its gaps, or at the first one only."""
    by = sorted(order, key=lambda i: boxes[i][start])
    parts: list[list[int]] = [[by[0]]]
    reach = boxes[by[0]][end]
    for k, i in enumerate(by[1:], 1):
        if boxes[i][start] >= reach:
            if not all_gaps:
                return [by[:k], by[k:]]
            parts.append([])
        parts[-1].append(i)
        reach = max(reach, boxes[i][end])
    return parts


def cut_order(boxes: list[tuple], order: list[int]) -> list[int]:
    """The order of `layout.xy_cut` for the boxes of a slide in a file."""
    out: list[int] = []
    todo = [order]
    while todo:
        some = todo.pop()
        if len(some) < 2:
            out += some
            continue
        # what lies between two free rows has none any more, but a part of columns may have
        parts = _parted(boxes, some, 1, 3, True)
        if len(parts) == 1:
            parts = _parted(boxes, parts[0], 0, 2, False)
        if len(parts) == 1:
            out += sorted(parts[0], key=lambda i: (boxes[i][1], boxes[i][0]))
        else:
            todo += reversed(parts)
    return out


class Deck:
    """Slides of a presentation: shapes in reading order, as Markdown and as pictures."""

    def __init__(self, data: bytes):
        self.file = zipfile.ZipFile(io.BytesIO(data))
        targets = _relations(self.file, "ppt/presentation.xml")
        self.slides = [targets[_attribute(s, "id")] for s in _names(self._xml("ppt/presentation.xml"), "sldId")]

    def _xml(self, part: str) -> ET.Element:
        return ET.fromstring(self.file.read(part))

    @staticmethod
    def _box(shape: ET.Element) -> tuple[float, float, float, float]:
        frame = next(_names(shape, "xfrm"), None)
        place = {} if frame is None else {e.tag.rpartition("}")[2]: e for e in frame}
        x, y = (float(place["off"].get(k, 0)) if "off" in place else 0.0 for k in ("x", "y"))
        w, h = (float(place["ext"].get(k, 0)) if "ext" in place else 0.0 for k in ("cx", "cy"))
        return x, y, x + w, y + h

    def _ordered(self, tree: ET.Element) -> list[ET.Element]:
        """Shapes of a tree in reading order; a group is one box, in whose place its own shapes stand."""
        shapes = [e for e in tree if e.tag.rpartition("}")[2] in ("sp", "pic", "graphicFrame", "grpSp")]
        out: list[ET.Element] = []
        for i in cut_order([self._box(e) for e in shapes], list(range(len(shapes)))):
            out += self._ordered(shapes[i]) if shapes[i].tag.endswith("}grpSp") or shapes[i].tag == "grpSp" else [shapes[i]]
        return out

    def shapes(self, slide: str) -> tuple[str, list[tuple[int, str, ET.Element]]]:
        """Title, and (number, kind, shape) of the others."""
        title, rest = None, []
        for j, shape in enumerate(self._ordered(next(_names(self._xml(slide), "spTree"))), 1):
            if title is None and any(h.get("type") in ("title", "ctrTitle") for h in _names(shape, "ph")):
                title = "\n".join(_text(p) for p in _names(shape, "p")).strip()
            else:
                kind = {"pic": "picture", "graphicFrame": "table"}.get(shape.tag.rpartition("}")[2], "text")
                rest.append((j, kind, shape))
        return title or "", rest

    def picture(self, slide: str, number: int, j: int, shape: ET.Element) -> tuple[str, str, str] | None:
        """Alt text, name and part of a picture: its description, else its name."""
        target = next((_relations(self.file, slide).get(_attribute(b, "embed")) for b in _names(shape, "blip")), None)
        if not target or target not in self.file.namelist():
            return None
        about = next(_names(shape, "cNvPr"), None)
        alt = ((about.get("descr") or "").strip() or about.get("name") or "") if about is not None else ""
        return alt or f"Image_S{number}_P{j}", f"slide_{number}_shape_{j}{posixpath.splitext(target)[1].lower()}", target

    def markdown(self, slide: str, number: int, j: int, kind: str, shape: ET.Element) -> str:
        if kind == "picture":
            found = self.picture(slide, number, j, shape)
            return f"![{found[0]}]({found[1]})" if found else ""
        if kind == "table":
            rows = [["\n".join(filter(None, (_text(p).strip() for p in _names(c, "p")))) for c in _names(r, "tc")] for r in _names(shape, "tr")]
            return table(rows) if rows and rows[0] else ""
        lines = []
        for p in _names(shape, "p"):
            level = next((int(x.get("lvl", 0)) for x in _names(p, "pPr")), 0)
            if text := _text(p).strip():
                lines.append("    " * level + f"* {text}")
        return "\n".join(lines)

    def rows(self) -> Iterator[tuple[int, str, list[str], list[str]]]:
        """Number, title, texts of the shapes in reading order and notes of each slide."""
        for number, slide in enumerate(self.slides, 1):
            title, shapes = self.shapes(slide)
            yield number, title, [x for x in (self.markdown(slide, number, *shape) for shape in shapes) if x], self.notes(slide)

    def notes(self, slide: str) -> list[str]:
        parts = [p for p in _relations(self.file, slide).values() if "notesSlide" in p and p in self.file.namelist()]
        bodies = [s for p in parts for s in _names(self._xml(p), "sp") if not any(h.get("type") in ("sldImg", "sldNum", "dt", "hdr", "ftr") for h in _names(s, "ph"))]
        return [x for s in bodies for x in (_text(p).strip() for p in _names(s, "p")) if x]


@register(".pptx")
def pptx_to_markdown(data: bytes, stem: str) -> str:
    """Front matter, then slides with title, shapes in reading order, notes as a quotation, and `---` after each.

    Texts are list items by level, tables and pictures Markdown ones; pictures are named as `slide_pictures` names them.
    """
    deck = Deck(data)
    out = [f"---\ntitle: {stem}.pptx\ntotal_slides: {len(deck.slides)}\n---"]
    for _, title, body, notes in deck.rows():
        quoted = ["\n".join(["> **Speaker Notes:**", *[f"> {n}" for n in notes]])] if notes else []
        out += [f"## {title or '[Untitled Slide]'}", *body, *quoted, "---"]
    return "\n\n".join(out)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])))
def _pictures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        rows = []
        for data in contents:
            try:
                deck = Deck(data)
            except (zipfile.BadZipFile, KeyError, ET.ParseError):  # to_markdown tells what is wrong
                rows.append([])
                continue
            found = [deck.picture(slide, n, j, shape) for n, slide in enumerate(deck.slides, 1) for j, kind, shape in deck.shapes(slide)[1] if kind == "picture"]
            rows.append([{"name": x[1], "content": deck.file.read(x[2])} for x in found if x])
        yield pd.Series(rows, dtype=object)


def slide_pictures(files: DataFrame) -> DataFrame:
    """Pictures of presentations: document_id, name, content."""
    rows = files.where(F.col("ext") == ".pptx").select("document_id", F.explode(_pictures("content")).alias("p"))
    return rows.select("document_id", "p.name", "p.content")


@register(".pdf", *IMAGES)
def needs_provider(data: bytes, stem: str) -> str:
    raise ProviderMissing("register a converter for this extension: text extraction and recognition are providers")


def convert(data: bytes, extension: str, stem: str) -> str:
    """Markdown of a file by its registered converter."""
    return _CONVERTERS[extension](data, stem)


def normal_extension(ext: Column) -> Column:
    """Legacy office extensions as their successors."""
    pairs = F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv])
    return F.coalesce(pairs[ext], ext)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows: path, source_file, ext, document_id (SHA-256 of the bytes), length, content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", t.basename(F.col("path")).alias("source_file"), t.extension(F.col("path")).alias("ext"), F.sha2("content", 256).alias("document_id"), "length", "content")


def accepted(files: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files within the size limit and of a known format, and the rejected ones with the reason."""
    reason = F.when(F.col("length") > most, "too_large").when(~F.coalesce(F.col("ext").isin(converter_extensions()), F.lit(False)), "unsupported_format")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").drop("content")


@pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]))
def _convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for exts, stems, contents in batches:
        rows = []
        for ext, stem, data in zip(exts, stems, contents, strict=True):
            try:
                rows.append((_CONVERTERS[ext](data, stem), None))
            except Exception as e:  # a broken file is a row with its error, not the end of the job
                rows.append((None, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(rows, columns=["markdown", "error"])


def to_markdown(files: DataFrame, *more: str) -> DataFrame:
    """Rows (document_id, source_file, markdown, error, and more columns) of files by their registered converter."""
    return files.withColumn("made", _convert("ext", t.stem(F.col("source_file")), "content")).select("document_id", "source_file", "made.markdown", "made.error", *more)


def asset_allowed(document_id: Column, path: Column, extensions: tuple[str, ...] = IMAGES) -> Column:
    """Whether an asset may be read: a SHA-256 id, a path that stays below the document, a renderable format."""
    inside = ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^[/\\]|^[A-Za-z]:")
    return document_id.rlike("^[a-f0-9]{64}$") & inside & t.extension(path).isin(*extensions)


def asset_url(base: Column, document_id: Column, path: Column) -> Column:
    """The address of an asset below `base`, null where it may not be read."""
    inner = F.regexp_replace(path, r"^\./", "")
    return F.when(asset_allowed(document_id, inner), F.concat_ws("/", F.regexp_replace(base, "/+$", ""), document_id, inner))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as rows: source_file, markdown."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(t.basename(F.input_file_name()).alias("source_file"), F.col("value").alias("markdown"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """Markdown by document, 256 folders of documents by the digest of their id."""
    rows = documents.select(F.left(F.sha1(F.col("document_id").cast("string").cast("binary")), F.lit(2)).alias("part"), "document_id", "markdown")
    rows.write.mode("overwrite").partitionBy("part").parquet(path)
