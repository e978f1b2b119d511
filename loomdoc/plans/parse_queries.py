"""The parse of documents from characters that are made of the tables at hand, and office files that are written and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.operators import parse
from loomdoc.plans.registry import query
from loomdoc.session import scratch, stored, table
from loomdoc.sources import datasource, office

# A brand is a catalogue: eight parts on a page, four in each column, under a header; an image follows a page's second part.
# In catalogues of an odd number, words stand so close that they run together; their lines stay by themselves.
_PARTS = "(SELECT *, i // 8 + 1 AS page, i % 8 AS slot, right(p_brand, 1)::INT % 2 = 1 AS tight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part))"


@query(f"""WITH p AS {_PARTS}, n AS (SELECT p_brand, max(page) AS pages FROM p GROUP BY p_brand),
pieces AS (
  SELECT p_brand, page, slot, 0 AS k, '# Part ' || p_partkey AS line FROM p
  UNION ALL SELECT p_brand, page, slot, 1, CASE WHEN tight THEN p_name || chr(10) || 'in ' || p_brand || ' of size ' || p_size ELSE p_name || ' in ' || p_brand || ' of size ' || p_size END FROM p
  UNION ALL SELECT p_brand, page, slot, 2, '* ' || p_type || ' ' || p_partkey FROM p
  UNION ALL SELECT p_brand, page, slot, 3, chr(10) || '<img> part_' || p_partkey || '.png' FROM p WHERE slot = 1
  UNION ALL SELECT DISTINCT p_brand, page, -1, 0, 'Catalogue of ' || p_brand FROM p JOIN n USING (p_brand) WHERE pages < 3
), numbered AS (SELECT *, row_number() OVER (PARTITION BY p_brand, page ORDER BY slot, k) = 1 AS turn FROM pieces)
SELECT p_brand, string_agg(CASE WHEN turn THEN chr(10) || '<!-- page: ' || page || ' -->' || chr(10) ELSE '' END || CASE WHEN line LIKE '# %' THEN chr(10) ELSE '' END || line || chr(10), '' ORDER BY page, slot, k) AS markdown
FROM numbered GROUP BY p_brand""")
def document_parse(spark: SparkSession, root: str) -> DataFrame:
    """Catalogues from their characters: columns, bands around images, both ways to lines, types by font, margins, order, Markdown."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    parts = table(spark, root, "part").select("p_brand", "p_partkey", "p_name", "p_type", "p_size", i.alias("i"))
    parts = stored(parts.withColumn("page_number", F.floor(F.col("i") / 8).cast("int") + 1).withColumn("slot", F.col("i") % 8), "catalogues")
    left, top = F.floor(F.col("slot") / 4) * 270 + 60.0, F.col("slot") % 4 * 150 + 60.0
    name = F.concat(F.lit("in "), "p_brand", F.lit(" of size "), "p_size")
    texts = [F.concat(F.lit("Part "), "p_partkey"), F.col("p_name"), name, F.concat(F.lit("- "), "p_type", F.lit(" "), "p_partkey")]
    made = F.array(*[F.struct(F.lit(float(20 * k)).alias("down"), F.lit(10.0 if k else 16.0).alias("size"), F.lit("Sans" if k else "Sans-Bold").alias("font"), x.alias("text")) for k, x in enumerate(texts)])
    lines = parts.select("p_brand", "page_number", left.alias("x0"), top.alias("at"), F.explode(made).alias("m")).select("p_brand", "page_number", "x0", (F.col("at") + F.col("m.down")).alias("top"), "m.size", "m.font", "m.text")
    sheets = parts.select("p_brand", "page_number", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")).distinct()
    header = sheets.select("p_brand", "page_number", F.lit(60.0).alias("x0"), F.lit(10.0).alias("top"), F.lit(10.0).alias("size"), F.lit("Sans").alias("font"), F.concat(F.lit("Catalogue of "), "p_brand").alias("text"))
    tight = F.right("p_brand", F.lit(1)).cast("int") % 2 == 1
    chars = parse.characters(lines.unionByName(header), ["p_brand", "page_number"], gap=F.when(tight, 2.5).otherwise(6.0))
    images = parts.where("slot = 1").select("p_brand", "page_number", F.lit(60.0).alias("x0"), F.lit(310.0).alias("top"), F.lit(160.0).alias("x1"), F.lit(340.0).alias("bottom"), F.concat(F.lit("part_"), "p_partkey", F.lit(".png")).alias("content"), F.lit("image").alias("block_type"))
    return parse.document_parse(sheets, chars, images, "p_brand")


def _written(rows: DataFrame, file: str, order: str, make) -> str:
    """A file for every value of `file` (its name), made in a task of that file's rows; the folder they are in."""
    folder = scratch(rows.sparkSession, "office")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [datasource.write_file(folder, group[file].iloc[0], make(group.sort_values(order)))]})

    stored(rows.groupBy(file).applyInPandas(run, "path string"), "office-written")
    return folder


# Suppliers of a nation are workbooks of a thousand keys each.
@query("""SELECT 'n' || s_nationkey || 'p' || s_suppkey // 1000 AS sheet, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey)::INT AS row, s_suppkey || '|' || s_name || '|&<>' || s_nationkey AS cells, NULL::VARCHAR AS error FROM supplier
UNION ALL SELECT DISTINCT 'n' || s_nationkey || 'p' || s_suppkey // 1000, 0, 'key|name|nation', NULL FROM supplier""")
def xlsx_rows(spark: SparkSession, root: str) -> DataFrame:
    """Workbooks that tasks write, read again by the data source."""
    name = F.concat(F.lit("n"), "s_nationkey", F.lit("p"), F.floor(F.col("s_suppkey") / 1000).cast("string"))
    rows = table(spark, root, "supplier").select(name.alias("sheet"), F.concat(name, F.lit(".xlsx")).alias("file"), "s_suppkey", "s_name", "s_nationkey")

    def book(rows: pd.DataFrame) -> bytes:
        lines = [[str(k), n, f"&<>{m}"] for k, n, m in zip(rows["s_suppkey"], rows["s_name"], rows["s_nationkey"], strict=True)]
        return office.workbook({rows["sheet"].iloc[0]: [["key", "name", "nation"], *lines]})

    folder = _written(rows, "file", "s_suppkey", book)
    datasource.register(spark)
    found = spark.read.format("office").option("rows", "sheets").load(folder)
    return found.select("sheet", "row", F.array_join("cells", "|").alias("cells"), "error")


# Documents are slides of decks of fifty keys each.
@query(r"""SELECT 'deck' || doc_id // 50 || '.pptx' AS file, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id)::INT AS slide, 'Document ' || doc_id AS title, '* ' || source || chr(10) || '* ' || lang || CASE WHEN t = '' THEN '' ELSE chr(10) || '* ' || t END AS body, NULL::VARCHAR AS error
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g')) AS t FROM documents)""")
def pptx_slides_read(spark: SparkSession, root: str) -> DataFrame:
    """Presentations that tasks write, read again by the data source."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " "))
    file = F.concat(F.lit("deck"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".pptx"))
    rows = table(spark, root, "documents").select(file.alias("file"), "doc_id", "source", "lang", text.alias("text"))

    def deck(rows: pd.DataFrame) -> bytes:
        return office.presentation([(f"Document {k}", [s, x, t]) for k, s, x, t in zip(rows["doc_id"], rows["source"], rows["lang"], rows["text"], strict=True)])

    folder = _written(rows, "file", "doc_id", deck)
    datasource.register(spark)
    found = spark.read.format("office").option("rows", "slides").load(folder)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "slide", "title", F.array_join("body", "\n").alias("body"), "error")
