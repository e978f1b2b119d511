"""Articles, logs, index maintenance, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import text as t
from loomdoc.operators import articles as a
from loomdoc.operators import buckets, chunkers, evaluation, index, lifecycle, substring
from loomdoc.plans.registry import query
from loomdoc.session import scratch, table
from loomdoc.sources import office

_TIME = "TIMESTAMP '2024-01-01 00:00:00'"


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Documents as articles: the digest of the text is the document_id, the first words are the title."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("document_id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"), F.concat("source", F.lit(".md")).alias("source_file"), now.alias("created_at"), now.alias("updated_at"))


@query("""SELECT (SELECT count(*) FROM documents) AS total_articles, (SELECT count(*) FROM conversations WHERE role = 'user') AS total_questions, (SELECT count(*) FROM embeddings) AS total_chunks""")
def stats_row(spark: SparkSession, root: str) -> DataFrame:
    return a.statistics(articles(spark, root), table(spark, root, "conversations").where("role = 'user'"), table(spark, root, "embeddings"))


@query("SELECT doc_id::VARCHAR AS id, text[1:20] AS title FROM documents ORDER BY id LIMIT 20 OFFSET 40")
def article_list_page(spark: SparkSession, root: str) -> DataFrame:
    return a.list_page(articles(spark, root), skip=40, limit=20).select("id", "title")


@query("SELECT id, title, true AS has_next FROM (SELECT doc_id::VARCHAR AS id, text[1:20] AS title FROM documents ORDER BY id LIMIT 20)")
def article_page_with_next(spark: SparkSession, root: str) -> DataFrame:
    return a.page_with_next(articles(spark, root), 0, 20).select("id", "title", "has_next")


@query("SELECT doc_id::VARCHAR AS id, text[1:20] AS title FROM documents WHERE translate(text[1:20], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%' ORDER BY id LIMIT 100")
def title_search_ci(spark: SparkSession, root: str) -> DataFrame:
    return a.list_page(articles(spark, root), limit=1000, search=" ThE ").select("id", "title")


@query("SELECT doc_id::VARCHAR AS id, sha256(text) AS document_id, source || '.md' AS source_file FROM documents WHERE doc_id = 17")
def article_point_lookup(spark: SparkSession, root: str) -> DataFrame:
    return a.by_id(articles(spark, root), "17").select("id", "document_id", "source_file")


@query("""SELECT sha256(text) AS document_id, min(doc_id)::VARCHAR AS id, arg_max(source, doc_id) || '.md' AS source_file, count(*) AS writes FROM documents GROUP BY text""")
def upsert_by_document_id(spark: SparkSession, root: str) -> DataFrame:
    """All documents written in the order of their id: of equal texts the last write wins, the first id stays."""
    rows = articles(spark, root).withColumn("at", F.col("id").cast("long"))
    return a.last_writes(rows, "document_id", "at").select("document_id", "id", "source_file", "writes")


@query("""WITH old AS (SELECT doc_id, source, lang FROM documents WHERE lang <> 'de'), new AS (SELECT doc_id, source || '-new' AS source FROM documents WHERE lang <> 'fr')
SELECT doc_id::VARCHAR AS id, coalesce(new.source, old.source) AS source_file, old.doc_id IS NULL AS inserted FROM old FULL JOIN new USING (doc_id)""")
def upsert_merge(spark: SparkSession, root: str) -> DataFrame:
    """Two versions of the articles merged: one without German documents, a newer one without French ones."""
    rows = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("source").alias("source_file"))
    old, new = rows.where("lang <> 'de'").withColumn("inserted", F.lit(False)), rows.where("lang <> 'fr'").withColumn("source_file", F.concat("source_file", F.lit("-new"))).withColumn("inserted", F.lit(True))
    return a.upsert(old.drop("lang"), new.drop("lang"), key="id", kept=("inserted",)).select("id", "source_file", "inserted")


@query("SELECT sha256(text) AS document_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_document_ids(spark: SparkSession, root: str) -> DataFrame:
    return a.duplicates(articles(spark, root))


@query(f"""SELECT doc_id::VARCHAR AS id, coalesce('labelled ' || toxic, text[1:20]) AS title, source || '.md' AS source_file, CASE WHEN toxic IS NULL THEN {_TIME} ELSE {_TIME} + INTERVAL 1 DAY END AS updated_at
FROM documents LEFT JOIN labels USING (doc_id)""")
def update_partial(spark: SparkSession, root: str) -> DataFrame:
    """Labelled articles get a new title; their other fields stay."""
    changes = table(spark, root, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("labelled "), F.col("toxic").cast("string")).alias("title"), F.lit(None).cast("string").alias("source_file"))
    return a.update(articles(spark, root), changes, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("id", "title", "source_file", "updated_at")


@query("SELECT doc_id::VARCHAR AS id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS deleted FROM documents d")
def delete_returning(spark: SparkSession, root: str) -> DataFrame:
    ids = table(spark, root, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    stays, gone = a.delete(articles(spark, root), ids)
    return stays.select("id", F.lit(False).alias("deleted")).unionAll(gone.select("id", F.lit(True).alias("deleted")))


@query("""WITH u AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, text AS question, answer, 1 AS version FROM u WHERE role = 'user' AND next = 'assistant' AND conv_id % 2 = 0
UNION ALL SELECT (SELECT count(*) FROM u WHERE role = 'user' AND next = 'assistant' AND conv_id % 2 = 0) + row_number() OVER (ORDER BY conv_id, turn), text, answer, 2 FROM u WHERE role = 'user' AND next = 'assistant' AND conv_id % 2 = 1""")
def qa_log_append(spark: SparkSession, root: str) -> DataFrame:
    """Questions with their answers, appended to the log in two writes: ids go on where the log ends."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, root, "conversations").withColumn("answer", F.lead("text").over(order)).withColumn("next", F.lead("role").over(order))
    asked = rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
    log = asked.limit(0).select(F.lit(0).cast("long").alias("id"), "question", "answer", F.lit(0).alias("version"))
    for half in (0, 1):
        new = asked.where(F.col("conv_id") % 2 == half).withColumn("version", F.lit(half + 1))
        log = a.appended(log, new, ["conv_id", "turn"])
    return log


@query("""SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role ELSE NULL END AS sources FROM conversations""")
def db_migration_backfill(spark: SparkSession, root: str) -> DataFrame:
    """Messages as logs of the old form: some have a list already, some an empty or no list, some nothing at all. Twice, as it is idempotent."""
    turn = F.col("turn") % 3
    rows = table(spark, root, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(turn == 0, F.lit("old")).when(turn == 1, F.col("role")).alias("source"), F.when(turn == 0, F.col("text")).when(turn == 1, F.when(F.col("conv_id") % 2 == 0, "[]")).alias("sources"))
    return a.migrated(a.migrated(rows))


# Documents as files of twenty kinds of names by their number; what a kind is, the library's registries say.
_KINDS = ["a.bmp", "b.DOCX", "c.gif", "d.jpeg", "e.jpg", "f.pdf", "g.png", "h.pptx", "i.tif", "j.tiff", "k.webp", "l.xlsm", "m.x.xlsx", "n.txt", "o.doc", "p.PPT", "q.xls", "r.md", "s", ".pdf"]
_NAMED = f"(SELECT lower(regexp_extract([{', '.join(repr(k) for k in _KINDS)}][doc_id % 20 + 1], '.(\\.[^.]+)$', 1)) AS ext FROM documents)"
_BOTH = "'.bmp', '.docx', '.gif', '.jpeg', '.jpg', '.pdf', '.png', '.pptx', '.tif', '.tiff', '.webp', '.xlsm', '.xlsx'"


def _extensions(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return table(spark, root, "documents").select(t.extension(F.get(names, (F.col("doc_id") % 20).cast("int"))).alias("ext"))


@query(f"SELECT ext, count(*) AS files FROM {_NAMED} WHERE ext IN ({_BOTH}) GROUP BY ext")
def format_intersection(spark: SparkSession, root: str) -> DataFrame:
    """Extensions of files that have both a converter and a chunker, and how many files that is."""
    files = _extensions(spark, root)
    some = lambda names: files.where(F.col("ext").isin(names)).select("ext").distinct()
    both = some(office.converter_extensions()).intersect(some(chunkers.chunk_extensions()))
    return files.groupBy("ext").agg(F.count("*").alias("files")).join(both, "ext")


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of documents as chunks."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, root, "documents").select(F.col("doc_id").alias("article_id"), F.sha2("text", 256).alias("document_id"), F.posexplode(lines).alias("chunk", "content")).withColumn("metadata", F.create_map(F.lit("page_number"), F.col("chunk").cast("string"), F.lit("block_type"), F.lit("paragraph")))


_HASH = r"""sha256('{"content": "' || replace(replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\', '\\'), '"', '\"') || '", "document_id": "' || sha256(text) || '", "embedding_model": "nomic-embed-text", "metadata": {"block_type": "paragraph", "page_number": ' || i || '}, "parser_version": "structure-v2"}')"""
_LINES = r"(SELECT doc_id, text, i, l[i + 1] AS line FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), unnest(range(0, len(l))) AS u(i))"


@query(f"SELECT doc_id AS article_id, h AS content_hash, doc_id || ':' || h[1:32] AS chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index FROM (SELECT doc_id, i, {_HASH} AS h FROM {_LINES} q)")
def content_hash(spark: SparkSession, root: str) -> DataFrame:
    return index.prepared(_lines(spark, root)).select("article_id", "content_hash", "chunk_id", "chunk_index")


@query("SELECT source, sha1(replace(lower(source), 'ß', 'ss'))[1:12] AS digest, 'page:0:' || sha1(replace(lower(source), 'ß', 'ss'))[1:12] AS parent_id FROM (SELECT DISTINCT source FROM documents)")
def parent_id(spark: SparkSession, root: str) -> DataFrame:
    digest = F.left(F.sha1(t.casefold(F.col("source")).cast("binary")), F.lit(12))
    return table(spark, root, "documents").select("source").distinct().select("source", digest.alias("digest"), F.concat(F.lit("page:0:"), digest).alias("parent_id"))


def _index(spark: SparkSession, root: str) -> DataFrame:
    """The index of an older version: embeddings of the first documents by number, with a hash of their text."""
    old = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return table(spark, root, "embeddings").join(old, F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("article_id"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.left("content_hash", F.lit(32))).alias("chunk_id"), "content_hash", "embedding")


def _new(spark: SparkSession, root: str) -> DataFrame:
    """The new version: labelled documents of low quality have changed."""
    rows = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id", "left")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    made = rows.select(F.col("doc_id").alias("article_id"), F.sha2(text, 256).alias("content_hash"))
    return made.withColumn("chunk_id", F.concat(F.col("article_id").cast("string"), F.lit(":"), F.left("content_hash", F.lit(32))))


_NEW = "(SELECT doc_id, sha256(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS new, sha256(text) AS old FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT doc_id AS article_id, vec_id IS NOT NULL AND new = old AS reused FROM {_NEW} n LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_reuse_join(spark: SparkSession, root: str) -> DataFrame:
    d = index.delta(_index(spark, root), _new(spark, root))
    return d.to_embed.select("article_id", F.lit(False).alias("reused")).unionAll(d.reused.select("article_id", F.lit(True).alias("reused")))


@query(f"SELECT doc_id AS article_id, doc_id || ':' || old[1:32] AS chunk_id FROM {_NEW} n JOIN embeddings ON vec_id = doc_id WHERE new <> old")
def stale_delta(spark: SparkSession, root: str) -> DataFrame:
    return index.delta(_index(spark, root), _new(spark, root)).to_delete


@query(f"""SELECT doc_id AS article_id, doc_id || ':' || new[1:32] AS chunk_id, CASE WHEN new = old AND vec_id IS NOT NULL THEN round(list_sum(embedding)::DOUBLE, 3) ELSE length(new)::DOUBLE END AS embedding
FROM {_NEW} n LEFT JOIN embeddings ON vec_id = doc_id""")
def replace_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The index after the change: reused embeddings by their sum, new ones by what the provider gives."""
    embed = lambda rows: rows.withColumn("embedding", F.array(F.length("content_hash").cast("float")))
    new = _new(spark, root)
    after = lifecycle.changed_index(_index(spark, root), new, new.select("article_id"), embed)
    total = F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y)
    return after.select("article_id", "chunk_id", F.round(total, 3).alias("embedding"))


@query("SELECT vec_id, label, false AS broken FROM embeddings")
def snapshot_restore_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """A version without the labelled rows is written and rolled back: the first version is what stays."""
    rows = table(spark, root, "embeddings").select("vec_id", "label", F.lit(False).alias("broken"))
    kept = index.VersionedTable(spark, scratch(spark, "snapshot"))
    kept.write(rows)
    stays, _ = a.delete(rows, table(spark, root, "labels").select(F.col("doc_id").alias("vec_id")), key="vec_id")
    kept.write(stays.withColumn("broken", F.lit(True)))
    kept.rollback()
    return kept.read()


@query("""SELECT problem, count(*) AS chunks, array_to_string(list(id ORDER BY id)[1:5], ', ') || CASE WHEN count(*) > 5 THEN ' ... and ' || (count(*) - 5) || ' more' ELSE '' END AS sample
FROM (SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 7 = 0 THEN 'empty_metadata' WHEN item_id % 3 = 0 THEN 'missing_both_fields' WHEN d.doc_id IS NULL THEN 'orphan' WHEN NOT contains(d.text, trim(b.text)) THEN 'stale' END AS problem
  FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 29) WHERE problem IS NOT NULL GROUP BY problem""")
def problem_samples(spark: SparkSession, root: str) -> DataFrame:
    return index.listed(index.integrity(*_checked_chunks(spark, root)), 5)


@query(f"SELECT doc_id AS article_id FROM {_NEW} n LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL")
def missing_after_seed(spark: SparkSession, root: str) -> DataFrame:
    return lifecycle.missing_ids(_index(spark, root), table(spark, root, "documents").select(F.col("doc_id").alias("article_id")))


@query(f"SELECT ext, count(*) AS files FROM {_NAMED} WHERE ext IN ({_BOTH}, '.doc', '.ppt', '.xls') GROUP BY ext")
def all_formats(spark: SparkSession, root: str) -> DataFrame:
    """Extensions of files that have a converter, or a successor that has, and how many files that is."""
    files = _extensions(spark, root).groupBy("ext").agg(F.count("*").alias("files"))
    return files.where(F.col("ext").isin(office.converter_extensions())).union(files.where(F.col("ext").isin([*office.LEGACY]))).distinct()


@query("""SELECT vec_id, u.i::INT AS place, CASE WHEN u.i <= len(embedding) THEN embedding[u.i] END AS number, CASE WHEN u.i <= 3 THEN vec_id || '-' || u.i END AS name FROM embeddings, unnest(range(1, greatest(len(embedding), 3) + 1)) AS u(i)""")
def zipped_lists(spark: SparkSession, root: str) -> DataFrame:
    """Lists side by side by place; the shorter one is null at its end."""
    names = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.col("vec_id").cast("string"), F.lit("-"), i.cast("string")))
    rows = table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("number"), names.alias("name"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("number", "name")).alias("at", "z")).select("vec_id", (F.col("at") + 1).alias("place"), "z.number", "z.name")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '/assets/' || sha256(text) || '/images/' || doc_id || '.png' END AS url FROM documents""")
def asset_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of assets: none for a path that leaves the document's folder."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("images/../../"), name)).otherwise(F.concat(F.lit("./images/"), name))
    return table(spark, root, "documents").select("doc_id", office.asset_url(F.lit("/assets/"), F.sha2("text", 256), path).alias("url"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch(ts))::BIGINT AS seconds FROM events""")
def iso_times(spark: SparkSession, root: str) -> DataFrame:
    """Times written with and without a zone, and read again: those without one are of zone Z."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.concat(iso, F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return table(spark, root, "events").select("event_id", iso.alias("iso"), F.unix_timestamp(t.iso_timestamp(written)).alias("seconds"))


@query("""SELECT source, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM documents)) AS share FROM documents GROUP BY source""")
def source_shares(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("all"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("source", evaluation.percent(F.col("n") / F.col("all")).alias("share"))


def _checked_chunks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as chunks of the articles of their number; every seventh without metadata, every third without names."""
    items = table(spark, root, "benchmark")
    chunks = items.select(F.col("item_id").cast("string").alias("chunk_id"), (F.col("item_id") % 7 != 0).alias("has_metadata"), F.when(F.col("item_id") % 3 != 0, (F.col("item_id") * 29).cast("string")).alias("article_id"), F.when(F.col("item_id") % 6 == 0, " ").alias("source_file"), "text")
    return chunks, table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


_CHECKED = """(SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'empty_metadata' WHEN item_id % 3 = 0 THEN 'missing_both_fields' WHEN d.doc_id IS NULL THEN 'orphan' WHEN NOT contains(d.text, trim(b.text)) THEN 'stale' END AS problem
FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 29)"""


@query(f"SELECT item_id::VARCHAR AS chunk_id, problem FROM {_CHECKED} q")
def chunk_problems(spark: SparkSession, root: str) -> DataFrame:
    return index.integrity(*_checked_chunks(spark, root)).select("chunk_id", "problem")


@query(f"SELECT count(*) AS total_chunks, count(*) FILTER (problem = 'empty_metadata') AS empty_metadata, count(*) FILTER (problem = 'missing_both_fields') AS missing_both_fields, count(*) FILTER (problem = 'orphan') AS orphan, count(*) FILTER (problem = 'stale') AS stale FROM {_CHECKED} q")
def integrity_report(spark: SparkSession, root: str) -> DataFrame:
    return index.report(index.integrity(*_checked_chunks(spark, root)))


@query(f"SELECT item_id::VARCHAR AS chunk_id FROM {_CHECKED} q WHERE coalesce(problem, 'stale') = 'stale'")
def integrity_cleanup(spark: SparkSession, root: str) -> DataFrame:
    chunks, now = _checked_chunks(spark, root)
    return index.cleaned(chunks, index.integrity(chunks, now)).select("chunk_id")


@query("SELECT item_id::VARCHAR AS chunk_id FROM benchmark WHERE item_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = item_id * 29)")
def orphan_chunks(spark: SparkSession, root: str) -> DataFrame:
    return index.orphans(*_checked_chunks(spark, root)).select("chunk_id")


@query("SELECT item_id::VARCHAR AS chunk_id FROM benchmark b JOIN documents d ON d.doc_id = item_id * 29 WHERE item_id % 3 <> 0 AND NOT contains(d.text, trim(b.text))")
def stale_chunks(spark: SparkSession, root: str) -> DataFrame:
    return index.stale(*_checked_chunks(spark, root)).select("chunk_id")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE json_type(props, '$.' || k) NOT IN ('NULL', 'OBJECT', 'ARRAY')""")
def metadata_scalars(spark: SparkSession, root: str) -> DataFrame:
    """Scalar values of JSON metadata, nulls and nested ones left out."""
    rows = table(spark, root, "events").select("event_id", F.explode(F.from_json("props", T.MapType(T.StringType(), T.StringType()))).alias("name", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\[{]")).select("event_id", "value", "name")


# Every hundredth document changes its text; what else is in the touched buckets is written again as it was.
_BUCKET = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 64"


@query(f"""WITH touched AS (SELECT DISTINCT {_BUCKET} AS b FROM documents WHERE doc_id % 100 = 7), l AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'changed' || chr(10) || text ELSE text END AS t, {_BUCKET} AS b FROM documents)
SELECT doc_id AS article_id, i::INT AS chunk_no, md5(p[i]) AS digest, b IN (SELECT b FROM touched) AS rewritten FROM (SELECT doc_id, b, string_split(t, chr(10)) AS p FROM l), unnest(range(1, len(p) + 1)) AS u(i)""")
def bucketed_commit(spark: SparkSession, root: str) -> DataFrame:
    """The index after a commit of a hundredth of the articles, and whether it wrote the row's bucket."""
    documents = table(spark, root, "documents").select(F.col("doc_id").alias("article_id"), "text")
    chunks = lambda rows: rows.select("article_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "content"))
    index = buckets.BucketedTable(spark, scratch(spark, "bucketed"), "article_id", 64)
    index.write(chunks(documents))
    changed = documents.where(F.col("article_id") % 100 == 7).withColumn("text", F.concat(F.lit("changed\n"), "text"))
    _, touched = index.commit(chunks(changed), changed)
    return index.read().select("article_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.md5(F.col("content").cast("binary")).alias("digest"), F.col("bucket").isin(touched).alias("rewritten"))


# Terms are six characters of every benchmark text, of some with a wildcard in the middle; the texts are whole documents.
_TERM = "CASE item_id % 3 WHEN 0 THEN text[3:8] WHEN 1 THEN text[3:5] || '_' || text[7:8] ELSE text[3:5] || '%' || text[9:11] END"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH t AS (SELECT item_id, '%' || {_ASCII.format(f"trim({_TERM})")} || '%' AS p FROM benchmark), d AS (SELECT doc_id, {_ASCII.format("text")} AS x FROM documents)
SELECT item_id, doc_id FROM t JOIN d ON x LIKE p""")
def title_search_indexed(spark: SparkSession, root: str) -> DataFrame:
    """Every term of a table in every text, by posting lists of trigrams."""
    at = lambda i, n: F.substring("text", i, n)
    term = F.when(F.col("item_id") % 3 == 0, at(3, 6)).when(F.col("item_id") % 3 == 1, F.concat(at(3, 3), F.lit("_"), at(7, 2))).otherwise(F.concat(at(3, 3), F.lit("%"), at(9, 3)))
    terms = table(spark, root, "benchmark").select("item_id", term.alias("term"))
    documents = table(spark, root, "documents")
    return substring.search(substring.index(documents, "doc_id", "text"), documents, "doc_id", "text", terms, "item_id", "term")
