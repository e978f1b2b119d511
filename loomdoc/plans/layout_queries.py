"""Page layout over boxes that are made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import layout
from loomdoc.plans.registry import query
from loomdoc.session import table

# Lines of documents as blocks: a page has ten of them, the first one of a page is the source's header.
_BLOCKS = r"""(SELECT doc_id, source, i, i // 10 AS page, i % 10 AS y, CASE WHEN i % 10 = 0 THEN 'Header of ' || source ELSE l[i + 1] END AS line
FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), unnest(range(0, len(l))) AS u(i))"""


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, root, "documents").select("doc_id", "source", F.posexplode(lines).alias("i", "line"))
    content = F.when(F.col("i") % 10 == 0, F.concat(F.lit("Header of "), "source")).otherwise(F.col("line"))
    return rows.select("doc_id", F.col("i").alias("block_id"), F.floor(F.col("i") / 10).cast("int").alias("page_number"), (F.col("i") % 10).cast("double").alias("y1"), F.lit(0.0).alias("x1"), content.alias("content"))


@query(rf"""WITH b AS (SELECT *, replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 'ß', 'ss') AS key, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS down FROM {_BLOCKS} q),
m AS (SELECT DISTINCT doc_id, page, key FROM b WHERE (up <= 2 OR down <= 2) AND key <> '' AND length(key) <= 160), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY doc_id),
o AS (SELECT doc_id, key FROM m JOIN p USING (doc_id) GROUP BY doc_id, key, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, trunc(pages * 0.6::DOUBLE + 0.999)))
SELECT doc_id, i::INT AS block_id FROM b WHERE NOT EXISTS (SELECT 1 FROM m JOIN o USING (doc_id, key) WHERE m.doc_id = b.doc_id AND m.page = b.page AND m.key = b.key)""")
def repeated_margins(spark: SparkSession, root: str) -> DataFrame:
    return layout.repeated_margins(_blocks(spark, root), "doc_id", "page_number").select("doc_id", "block_id")


@query(rf"""WITH b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM {_BLOCKS} q)
SELECT doc_id, string_agg(CASE WHEN y = 0 THEN chr(10) || '<!-- page: ' || page || ' -->' || chr(10) ELSE '' END || CASE WHEN i % 10 = 3 THEN chr(10) || '<img> ' || t || chr(10)
  WHEN y = 0 THEN chr(10) || '## ' || t || chr(10) WHEN i % 10 = 5 THEN '* ' || t || chr(10) ELSE t || chr(10) END, '' ORDER BY i) AS markdown FROM b GROUP BY doc_id""")
def markdown_compile(spark: SparkSession, root: str) -> DataFrame:
    rows = _blocks(spark, root).withColumn("position", F.col("block_id")).withColumn("block_type", F.when(F.col("y1") == 3, "image").when(F.col("y1") == 0, "h2").when(F.col("y1") == 5, "list_item").otherwise("paragraph"))
    return layout.compiled(rows, "doc_id")


@query("""WITH i AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000 % 86400)::DOUBLE AS y1, (epoch_us(ts) // 1000000 % 86400)::DOUBLE + value AS y2 FROM events),
r AS (SELECT *, max(y2) OVER (PARTITION BY user_id ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR y1 - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y1, y2 ROWS UNBOUNDED PRECEDING) AS band FROM r)
SELECT user_id, band::BIGINT AS band, round(min(y1), 4) AS y1, round(max(y2), 4) AS y2, count(*) AS n FROM b GROUP BY user_id, band""")
def interval_bands(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user as intervals in the seconds of a day."""
    rows = table(spark, root, "events").select("user_id", F.pmod(F.unix_timestamp("ts"), F.lit(86400)).cast("double").alias("y1"), "value").withColumn("y2", F.col("y1") + F.col("value"))
    return layout.bands(rows.select("user_id", "y1", "y2"), ["user_id"]).select("user_id", "band", F.round("y1", 4).alias("y1"), F.round("y2", 4).alias("y2"), "n")


@query("""WITH c AS (SELECT DISTINCT l_suppkey, trunc((l_quantity * 12) / 3)::INT AS b FROM lineitem WHERE l_quantity NOT BETWEEN 20 AND 27 AND l_quantity * 12 BETWEEN 48 AND 552),
g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY l_suppkey ORDER BY b) + 1, 16) AS s FROM c), w AS (SELECT l_suppkey, (b - s) * 3.0 AS gap, (b + s) / 2.0 * 3 AS center FROM g WHERE (b - s) * 3 > 15 AND (b + s) / 2.0 * 3 > 180 AND (b + s) / 2.0 * 3 < 420)
SELECT l_suppkey AS page, arg_max(center, {'gap': gap, 'c': -center})::DOUBLE AS center, max(gap)::DOUBLE AS gap FROM w GROUP BY l_suppkey""")
def column_gap(spark: SparkSession, root: str) -> DataFrame:
    """Quantities of a supplier's items as left edges on a page of 600 points, without the middle ones."""
    rows = table(spark, root, "lineitem").where("l_quantity not between 20 and 27").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 12).alias("x0"), F.lit(600.0).alias("page_width"))
    return layout.column_gap(rows, ["page"])


@query(r"""WITH s AS (SELECT p_brand, round_even(p_size / 3.0 * 2, 0) / 2 AS half, length(regexp_replace(p_name, '\s', '', 'g')) AS n FROM part), h AS (SELECT p_brand, half, sum(n) AS n FROM s GROUP BY ALL)
SELECT p_brand, arg_max(half, {'n': n, 'h': -half})::DOUBLE AS most_used, max(half)::DOUBLE AS largest FROM h GROUP BY p_brand""")
def font_mode(spark: SparkSession, root: str) -> DataFrame:
    """Parts of a brand as spans of text in a third of their size."""
    return layout.font_mode(table(spark, root, "part").select("p_brand", (F.col("p_size") / 3.0).alias("size"), F.col("p_name").alias("text")), ["p_brand"])


@query("""WITH w AS (SELECT o_custkey, o_orderkey, (o_orderkey % 997)::DOUBLE AS x0, (o_orderkey % 997)::DOUBLE + 20 AS x1 FROM orders), r AS (SELECT *, max(x1) OVER (PARTITION BY o_custkey ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
g AS (SELECT *, sum(CASE WHEN x0 - reach > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT o_custkey AS line, g::BIGINT AS "group", min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM g GROUP BY o_custkey, g""")
def line_gap_groups(spark: SparkSession, root: str) -> DataFrame:
    """Orders of a customer as words of a line."""
    x = (F.col("o_orderkey") % 997).cast("double")
    rows = table(spark, root, "orders").select(F.col("o_custkey").alias("line"), x.alias("x0"), (x + 20).alias("x1"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"), F.lit("w").alias("text"))
    out = layout.gap_groups(rows, ["line"], F.lit(40.0))
    return out.select("line", "group", "x0", "x1", F.size(F.split("text", " ")).cast("long").alias("n"))


@query("SELECT event_type, list(value ORDER BY value)[count(*) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def upper_median(spark: SparkSession, root: str) -> DataFrame:
    return layout.upper_median(table(spark, root, "events"), ["event_type"], "value")


_FONTS = "(SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '- ' || p_name WHEN 1 THEN upper(p_name[1:1]) || p_name[2:] WHEN 2 THEN 'Step ' || p_name ELSE lower(p_name) END AS line, p_size / 5.0 AS size, CASE WHEN p_partkey % 3 = 0 THEN 'Sans-Bold' ELSE 'Sans' END AS font FROM part)"


@query(rf"""SELECT p_partkey, CASE WHEN regexp_matches(line, '^(?:[-*•●] |\d+[.|)])') THEN 'list_item' WHEN size > 8.4::DOUBLE THEN CASE WHEN size >= 9.5::DOUBLE THEN 'h1' ELSE 'h2' END
WHEN font = 'Sans-Bold' AND starts_with(line, 'Step') THEN 'h2' WHEN font = 'Sans-Bold' AND regexp_matches(regexp_extract(line, '([\p{{L}}\p{{N}}])', 1), '[\p{{Lu}}\p{{N}}]') THEN 'h1' ELSE 'paragraph' END AS block_type FROM {_FONTS} q""")
def block_classifier(spark: SparkSession, root: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    line = F.when(size % 4 == 0, F.concat(F.lit("- "), name)).when(size % 4 == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))).when(size % 4 == 2, F.concat(F.lit("Step "), name)).otherwise(F.lower(name))
    font = F.when(F.col("p_partkey") % 3 == 0, "Sans-Bold").otherwise("Sans")
    kind = layout.block_type(line, size / 5.0, font, F.lit(8.0), F.lit(10.0), F.lit("Sans"), F.array(F.lit("Sans-Bold")))
    return table(spark, root, "part").select("p_partkey", kind.alias("block_type"))


@query("SELECT doc_id, '° ' || text || '   25°C – –55°C 3°°C/W ≈x≈' AS line FROM documents")
def text_repair(spark: SparkSession, root: str) -> DataFrame:
    made = F.concat(F.lit("(cid:25) "), "text", F.lit(" (cid:99)​ 25 C – –55 C 3 C/W «x»"))
    return table(spark, root, "documents").select("doc_id", layout.repaired(made).alias("line"))


@query(f"""SELECT doc_id, i::INT AS block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(ro, 1000000000), CASE WHEN ro IS NULL THEN round(y1, 1) ELSE 0 END, CASE WHEN ro IS NULL THEN x1 ELSE 0 END, i)::INT AS position
FROM (SELECT *, CASE WHEN i % 3 = 0 THEN (97 - i % 97)::INT END AS ro, (i * 7 % 10)::DOUBLE AS y1, (i * 3 % 5)::DOUBLE AS x1 FROM {_BLOCKS} q)""")
def reading_order(spark: SparkSession, root: str) -> DataFrame:
    i = F.col("block_id")
    rows = _blocks(spark, root).withColumn("reading_order", F.when(i % 3 == 0, 97 - i % 97)).withColumn("y1", (i * 7 % 10).cast("double")).withColumn("x1", (i * 3 % 5).cast("double"))
    return layout.reading_order(rows, ["doc_id"]).select("doc_id", "block_id", "position")


@query("""SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def markdown_table(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("n_regionkey", layout.markdown_table(F.array(F.lit("key"), F.lit("name")), cells).alias("markdown"))


# a value that comes n times moves a centre half way n times
_CENTRES = """list_reduce(list_transform(v, lambda x: {'done': []::DOUBLE[], 'last': x.v, 'n': x.n}), lambda a, x: CASE WHEN x.last - a.last > 3 THEN {'done': list_append(a.done, a.last), 'last': x.last, 'n': 0::BIGINT}
  ELSE {'done': a.done, 'last': x.last + (a.last - x.last) * pow(0.5, x.n), 'n': 0::BIGINT} END)"""


@query(f"""WITH c AS (SELECT p_brand, list({{'v': v, 'n': n}} ORDER BY v) AS v FROM (SELECT p_brand, (p_size + p_partkey % 10 / 10.0)::DOUBLE AS v, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand),
f AS (SELECT p_brand, {_CENTRES} AS f FROM c), l AS (SELECT p_brand, list_append(f.done, f.last) AS l FROM f)
SELECT p_brand, (u.i - 1)::INT AS "column", round(l[u.i], 6) AS centre FROM l, unnest(range(1, len(l) + 1)) AS u(i)""")
def column_centres(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of a brand's parts as where columns begin; the first of a new centre counts once however often it comes."""
    values = table(spark, root, "part").groupBy("p_brand", (F.col("p_size") + F.col("p_partkey") % 10 / 10.0).cast("double").alias("value")).agg(F.count("*").alias("n"))
    rows = values.groupBy("p_brand").agg(F.collect_list(F.struct("value", "n")).alias("x"))
    return rows.select("p_brand", F.posexplode(layout.column_centres(F.col("x"), 3.0)).alias("column", "centre")).select("p_brand", "column", F.round("centre", 6).alias("centre"))


# A part is a list of boxes and a path; what a free row or else the first free column parts goes on as parts of their own.
_CUTS = "list_filter(range(2, len(b) + 1), lambda i: b[i].{0} >= list_max(list_transform(b[1:i - 1], lambda x: x.{1})))"
_XY = f"""WITH RECURSIVE shapes AS (SELECT {{name}} AS slide, {{id}} AS id, {{x}}::DOUBLE AS x1, {{y}}::DOUBLE AS y1, {{x}}::DOUBLE + {{w}} AS x2, {{y}}::DOUBLE + {{h}} AS y2 FROM {{table}}),
parts AS (
  SELECT slide, '' AS path, list({{{{'y1': y1, 'x1': x1, 'id': id, 'y2': y2, 'x2': x2}}}}) AS b, false AS done FROM shapes GROUP BY slide
  UNION ALL
  SELECT slide, path || lpad(u.k::VARCHAR, 5, '0'), b[cuts[u.k]:coalesce(cuts[u.k + 1] - 1, len(b))], done FROM (
    SELECT slide, path, CASE WHEN len(down) > 0 OR len(across) = 0 THEN b ELSE c END AS b, len(down) + len(across) = 0 AS done, [1] || CASE WHEN len(down) > 0 THEN down ELSE across[1:1] END AS cuts FROM (
      SELECT slide, path, b, {_CUTS.format("y1", "y2")} AS down, c, {_CUTS.format("x1", "x2").replace("b[", "c[").replace("len(b)", "len(c)")} AS across
      FROM (SELECT slide, path, list_sort(b) AS b, list_transform(list_sort(list_transform(b, lambda x: {{{{'x1': x.x1, 'id': x.id, 'box': x}}}})), lambda x: x.box) AS c FROM parts WHERE NOT done)
    )
  ), unnest(range(1, len(cuts) + 1)) AS u(k)
), leaves AS (SELECT slide, path, unnest(b) AS x FROM parts WHERE done)
SELECT slide, x.id AS shape_id, (row_number() OVER (PARTITION BY slide ORDER BY path, x.y1, x.x1, x.id) - 1)::BIGINT AS position FROM leaves"""


@query(_XY.format(name="p_brand || '/' || p_size", id="p_partkey", x="p_partkey * 37 % 600", y="p_partkey * 91 % 400", w=40, h=15, table="part"))
def xy_cut(spark: SparkSession, root: str) -> DataFrame:
    """Parts of a brand and size as shapes of a slide."""
    x, y = (F.col("p_partkey") * 37 % 600).cast("double"), (F.col("p_partkey") * 91 % 400).cast("double")
    rows = table(spark, root, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("slide"), F.col("p_partkey").alias("shape_id"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 15).alias("y2"))
    return layout.xy_cut(rows, "slide").select("slide", "shape_id", "position")


# Lines of a page, one word after the other: sums and numbers of the lines so far, and the line of each word.
_LINES = """WITH RECURSIVE words AS ({words}),
usual AS (SELECT page, list(greatest(1.0, bottom - top) ORDER BY greatest(1.0, bottom - top))[count(*) // 2 + 1] AS median_height FROM words GROUP BY page),
pages AS (SELECT page, median_height, greatest(3.0, 0.55::DOUBLE * median_height) AS near, list({{'id': word_id, 'c': (top + bottom) / 2}} ORDER BY top, x0, word_id) AS w FROM words JOIN usual USING (page) GROUP BY page, median_height),
walk AS (
  SELECT page, 0 AS i, []::DOUBLE[] AS sums, []::INT[] AS ns, []::INT[] AS found FROM pages
  UNION ALL
  SELECT page, i + 1, CASE WHEN spot > len(sums) THEN list_append(sums, c) ELSE list_transform(sums, lambda x, k: CASE WHEN k = spot THEN x + c ELSE x END) END,
    CASE WHEN spot > len(ns) THEN list_append(ns, 1) ELSE list_transform(ns, lambda x, k: CASE WHEN k = spot THEN x + 1 ELSE x END) END, list_append(found, spot)
  FROM (SELECT walk.*, w[i + 1].c AS c, coalesce(list_filter(range(1, len(sums) + 1), lambda k: abs(w[i + 1].c - sums[k] / ns[k]) <= near)[1], len(sums) + 1)::INT AS spot FROM walk JOIN pages USING (page) WHERE i < len(w))
), ends AS (SELECT walk.*, w, median_height FROM walk JOIN pages USING (page) WHERE i = len(w)),
placed AS (SELECT page, w[u.k].id AS word_id, found[u.k] AS l, sums[found[u.k]] / ns[found[u.k]] AS mean, median_height FROM ends, unnest(range(1, len(w) + 1)) AS u(k)),
lined AS (SELECT page, word_id, (dense_rank() OVER (PARTITION BY page ORDER BY mean, l) - 1)::BIGINT AS line, median_height FROM placed)"""


_RECOGNISED = "SELECT o_custkey AS page, o_orderkey AS word_id, o_orderpriority AS text, (o_orderkey * 37 % 500)::DOUBLE AS x0, (o_orderkey * 13 % 60 * 14)::DOUBLE AS top, (o_orderkey * 37 % 500)::DOUBLE + 30 AS x1, (o_orderkey * 13 % 60 * 14)::DOUBLE + 10 AS bottom FROM orders"


@query(f"""{_LINES.format(words=_RECOGNISED)},
reach AS (SELECT words.*, line, median_height, max(x1) OVER (PARTITION BY page, line ORDER BY words.x0, words.x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words JOIN lined USING (page, word_id)),
parted AS (SELECT *, sum(CASE WHEN x0 - reach > greatest(40.0, median_height * 4) THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM reach),
grouped AS (SELECT page, line, g, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY x0, x1, text) AS text FROM parted GROUP BY page, line, g),
gaps AS (SELECT *, count(*) OVER p AS n, greatest(1.0, max(x1) OVER p - min(x0) OVER p) AS width, row_number() OVER q AS spot, lead(x0) OVER q AS next FROM grouped WINDOW p AS (PARTITION BY page), q AS (PARTITION BY page ORDER BY x0, top, g)),
best AS (SELECT page, max({{'gap': next - x0, 'spot': spot, 'divider': (x0 + next) / 2}}) FILTER (next IS NOT NULL) AS b FROM gaps GROUP BY page),
sides AS (SELECT gaps.*, b, CASE WHEN x0 < b.divider AND b.divider < x1 THEN 1 WHEN (x0 + x1) / 2 < b.divider THEN 2 ELSE 3 END AS side FROM gaps JOIN best USING (page)),
twos AS (SELECT *, coalesce(n >= 4 AND b.gap >= width * 0.25::DOUBLE AND b.spot >= 2 AND n - b.spot >= 2, false) AND count(*) FILTER (side = 2) OVER p >= 2 AND count(*) FILTER (side = 3) OVER p >= 2 AS two, min(top) FILTER (side > 1) OVER p AS first FROM sides WINDOW p AS (PARTITION BY page)),
places AS (SELECT *, CASE WHEN NOT two THEN 0 WHEN side = 1 AND top > first THEN 4 ELSE side END AS place FROM twos)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY place, top, x0)::INT AS position, x0, top, x1, bottom, text FROM places""")
def ocr_regions(spark: SparkSession, root: str) -> DataFrame:
    """Orders of a customer as recognised words of a page."""
    x, y = (F.col("o_orderkey") * 37 % 500).cast("double"), (F.col("o_orderkey") * 13 % 60 * 14).cast("double")
    rows = table(spark, root, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("word_id"), F.col("o_orderpriority").alias("text"), x.alias("x0"), y.alias("top"), (x + 30).alias("x1"), (y + 10).alias("bottom"))
    return layout.regions(rows, "page")
