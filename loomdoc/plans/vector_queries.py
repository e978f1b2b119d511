"""Search, context, citations, history, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions import vector as v
from loomdoc.operators import ann, evaluation, rag, search
from loomdoc.plans.registry import SQL, query
from loomdoc.session import stored, table

_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"
_DISTANCE = "list_sum(list_transform(list_zip(a.u, q.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _vector(spark: SparkSession, root: str, vec_id: int = 0) -> list[float]:
    return table(spark, root, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings with the text and metadata of the document of the same number."""
    documents = table(spark, root, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.col("lang").alias("file_type"), F.col("source").alias("source_file"))
    return table(spark, root, "embeddings").join(documents, "vec_id").withColumnRenamed("vec_id", "chunk_id")


@query(f"SELECT a.vec_id, round({_DISTANCE}, 4) AS distance FROM {_UNIT} a, {_UNIT} q WHERE q.vec_id = 0 ORDER BY {_DISTANCE}, a.vec_id LIMIT 50")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = search.top_k(table(spark, root, "embeddings"), _vector(spark, root), 50, threshold=None, key="vec_id")
    return rows.select("vec_id", F.round("distance", 4).alias("distance"))


@query(f"""SELECT a.vec_id AS chunk_id, source AS source_file, round({_DISTANCE}, 4) AS distance FROM {_UNIT} a JOIN documents ON doc_id = a.vec_id, {_UNIT} q
WHERE q.vec_id = 0 AND lang = 'en' ORDER BY {_DISTANCE}, a.vec_id LIMIT 5""")
def vector_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    rows = search.top_k(_chunks(spark, root), _vector(spark, root), 5, {"file_type": "en", "source_file": ""}, threshold=None)
    return rows.select("chunk_id", "source_file", F.round("distance", 4).alias("distance"))


@query(f"""SELECT * FROM (SELECT a.vec_id, round({_DISTANCE}, 4) AS distance, {_DISTANCE} AS d FROM {_UNIT} a, {_UNIT} q WHERE q.vec_id = 0 ORDER BY d, a.vec_id LIMIT 50)
WHERE d <= 1.6""".replace("SELECT * FROM", "SELECT vec_id, distance FROM", 1))
def vector_threshold_after_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = search.top_k(table(spark, root, "embeddings"), _vector(spark, root), 50, threshold=1.6, key="vec_id")
    return rows.select("vec_id", F.round("distance", 4).alias("distance"))


@query(f"""SELECT q.vec_id AS query_id, a.vec_id AS chunk_id, round({_DISTANCE}, 4) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DISTANCE}, 12), a.vec_id)::INT AS rank
FROM {_UNIT} a, {_UNIT} q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")
def vector_topk_batch(spark: SparkSession, root: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 20, against all rows."""
    rows = table(spark, root, "embeddings")
    return search.top_k_batch(rows.where(F.col("vec_id") % 20 == 0), rows, 5).select("query_id", "chunk_id", F.round("distance", 4).alias("distance"), "rank")


def _index(spark: SparkSession, root: str) -> ann.Index:
    rows = table(spark, root, "embeddings")
    return ann.build(rows, ann.fit(rows))


@query()
def vector_topk_ann(spark: SparkSession, root: str) -> DataFrame:
    """Approximate neighbours of all rows whose id is divisible by 20; the recall is that of about 256 of them against an exact scan."""
    rows = table(spark, root, "embeddings")
    queries = rows.where(F.col("vec_id") % 20 == 0)
    found = stored(ann.nearest(ann.calibrated(_index(spark, root)), queries), "ann-found")
    share = 256 / max(1, queries.count())
    some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))
    recall = ann.recall_of(found, search.top_k_batch(some, rows, 5)).first()["recall"]
    return found.select("query_id", "chunk_id", F.round("distance", 4).alias("distance"), "rank", F.round(F.lit(recall), 4).alias("recall"))


@query(SQL["vector_topk_batch"])
def vector_topk_pruned(spark: SparkSession, root: str) -> DataFrame:
    """The rows of vector_topk_batch from the index: only cells that can hold a neighbour are scanned."""
    found = ann.nearest_exactly(_index(spark, root), table(spark, root, "embeddings").where(F.col("vec_id") % 20 == 0))
    return found.select("query_id", "chunk_id", F.round("distance", 4).alias("distance"), "rank")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) AS length, len(embedding)::INT AS dimensions, true AS valid FROM embeddings")
def vector_norm_check(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.round(v.norm(F.col("embedding")), 4).alias("length"), F.size("embedding").alias("dimensions"), v.valid(F.col("embedding")).alias("valid"))


@query(f"""WITH hits AS (SELECT a.vec_id, {_DISTANCE} AS d FROM {_UNIT} a JOIN documents ON doc_id = a.vec_id, {_UNIT} q WHERE q.vec_id = 0 AND lang = 'en' ORDER BY d, a.vec_id LIMIT 5)
SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY d, vec_id)::INT AS label,
  '[S' || row_number() OVER (ORDER BY d, vec_id) || '] text : ' || text || chr(10) || 'source_file : ' || source || chr(10) || 'page_number : None' AS context
FROM hits JOIN documents ON doc_id = vec_id WHERE d <= 1.6""")
def cited_context(spark: SparkSession, root: str) -> DataFrame:
    hits = search.top_k(_chunks(spark, root), _vector(spark, root), 5, {"file_type": "en"}, threshold=1.6).withColumn("page_number", F.lit(None).cast("int"))
    return rag.context_rows(hits, ["text", "source_file", "page_number"], ["distance", "chunk_id"]).select("chunk_id", "label", "context")


@query(f"""WITH hits AS (SELECT a.vec_id, {_DISTANCE} AS d FROM {_UNIT} a JOIN documents ON doc_id = a.vec_id, {_UNIT} q WHERE q.vec_id = 0 ORDER BY d, a.vec_id LIMIT 5),
blocks AS (SELECT row_number() OVER (ORDER BY d, vec_id) AS n, '[S' || row_number() OVER (ORDER BY d, vec_id) || '] text : ' || text AS b FROM hits JOIN documents ON doc_id = vec_id)
SELECT 'Answer from the documents only.' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Không có' || chr(10) || chr(10) || 'What is new?' AS prompt FROM blocks""")
def prompt_context(spark: SparkSession, root: str) -> DataFrame:
    rows = rag.context_rows(search.top_k(_chunks(spark, root), _vector(spark, root), 5, threshold=None), ["text"], ["distance", "chunk_id"])
    blocks = rows.agg(F.array_sort(F.collect_list(F.struct("label", "context"))).alias("b")).select(F.array_join(F.transform("b", lambda x: x["context"]), "\n\n").alias("context"))
    return blocks.select(rag.prompt("Answer from the documents only.", F.col("context"), F.lit(""), F.lit("What is new?")).alias("prompt"))


@query("""SELECT conv_id, turn, role, trim(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n <= 6 AND role IN ('user', 'assistant') AND trim(text) <> ''""")
def history_window(spark: SparkSession, root: str) -> DataFrame:
    return rag.history_window(table(spark, root, "conversations")).select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, count(*) AS messages, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id""")
def history_text(spark: SparkSession, root: str) -> DataFrame:
    return rag.history_text(rag.history_window(table(spark, root, "conversations")))


# Answers with citations, some of them beyond the three chunks at hand: every message of an assistant, with labels from its turn.
_ANSWERS = """SELECT conv_id, turn, text || ' [S' || (turn % 4 + 1) || '] and [S2] or [S' || (turn % 5 + 3) || ']' || CASE WHEN conv_id % 7 = 0 THEN ' không có thông tin' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'"""


def _answers(spark: SparkSession, root: str) -> DataFrame:
    cite = lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))
    rows = table(spark, root, "conversations").where("role = 'assistant'")
    answer = F.concat("text", F.lit(" "), cite(F.col("turn") % 4 + 1), F.lit(" and [S2] or "), cite(F.col("turn") % 5 + 3), F.when(F.col("conv_id") % 7 == 0, " không có thông tin").otherwise(""))
    return rows.select("conv_id", "turn", answer.alias("answer"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x), ',') AS labels
FROM (SELECT conv_id, turn, regexp_extract_all(answer, '\[S(\d+)\]', 1) AS l FROM ({_ANSWERS}))""")
def citation_extract(spark: SparkSession, root: str) -> DataFrame:
    return _answers(spark, root).select("conv_id", "turn", F.array_join(rag.citations(F.col("answer")).cast("array<string>"), ",").alias("labels"))


@query(rf"""WITH a AS (SELECT *, contains(answer, 'không có thông tin') AS refused, regexp_extract_all(answer, '\[S(\d+)\]', 1) AS l FROM ({_ANSWERS})),
v AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i AND x::INT BETWEEN 1 AND 3) AS valid FROM a)
SELECT conv_id, turn, CASE WHEN refused THEN 'Tôi không tìm thấy thông tin này trong tài liệu.' ELSE regexp_replace(regexp_replace(answer, '\[S[4-9]\] ', '', 'g'), '\[S[4-9]\]', '', 'g') END AS cleaned,
  CASE WHEN refused THEN '' ELSE array_to_string(list_transform(valid, lambda x: ['a', 'b', 'c'][x::INT]), ',') END AS sources, CASE WHEN refused THEN 'insufficient_context' END AS no_answer_reason FROM v""")
def citation_clean(spark: SparkSession, root: str) -> DataFrame:
    rows = _answers(spark, root).withColumn("chunks", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return rag.answered(rows).select("conv_id", "turn", "cleaned", F.array_join("sources", ",").alias("sources"), "no_answer_reason")


# Questions are the vectors whose number is divisible by 20; the chunks are the English documents with a vector.
_ASKED = f"""WITH hits AS (SELECT q.vec_id AS question_id, a.vec_id AS chunk_id, {_DISTANCE} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DISTANCE}, 12), a.vec_id)::INT AS rank
FROM {_UNIT} a JOIN documents ON doc_id = a.vec_id, {_UNIT} q WHERE q.vec_id % 20 = 0 AND lang = 'en' QUALIFY rank <= 3), near AS (SELECT * FROM hits WHERE d <= 1.35)"""


def _asked(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    questions = table(spark, root, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), F.concat(F.lit("What is "), "vec_id", F.lit("?")).alias("question"), F.lit("").alias("history"), "embedding")
    return questions, search.semantic_search(questions, _chunks(spark, root), lambda q: q, 3, {"file_type": "en"}, threshold=1.35)


@query(f"{_ASKED} SELECT question_id, chunk_id, rank, round(d, 4) AS distance, source AS source_file FROM near JOIN documents ON doc_id = chunk_id")
def semantic_search(spark: SparkSession, root: str) -> DataFrame:
    return _asked(spark, root)[1].select("question_id", "chunk_id", "rank", F.round("distance", 4).alias("distance"), "source_file")


# The answers cite the first and the third chunk, and tell how long their prompt is.
@query(f"""{_ASKED}, p AS (SELECT question_id, list(chunk_id ORDER BY rank) AS c, length('Answer.' || chr(10) || chr(10) || string_agg('[S' || rank || '] text : ' || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Không có' || chr(10) || chr(10) || 'What is ' || question_id || '?') AS n
  FROM near JOIN documents ON doc_id = chunk_id GROUP BY question_id), q AS (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 20 = 0)
SELECT question_id, CASE WHEN c IS NULL THEN 'Tôi không tìm thấy thông tin này trong tài liệu.' ELSE n || ' [S1]' || CASE WHEN len(c) >= 3 THEN ' [S3] end' ELSE ' end' END END AS answer,
  CASE WHEN c IS NULL THEN '' WHEN len(c) >= 3 THEN c[1] || ',' || c[3] ELSE c[1]::VARCHAR END AS sources, CASE WHEN c IS NULL THEN 'insufficient_context' END AS no_answer_reason FROM q LEFT JOIN p USING (question_id)""")
def rag_answers(spark: SparkSession, root: str) -> DataFrame:
    questions, hits = _asked(spark, root)
    generate = lambda prompt: F.concat(F.length(prompt).cast("string"), F.lit(" [S1] [S3] end"))
    rows = rag.ask(questions, hits, generate, "Answer.", ["text"])
    return rows.select("question_id", F.col("cleaned").alias("answer"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), "no_answer_reason")


# Every benchmark text is a question; a document's keywords are the five words of over four letters that its whole text has most.
_HITS = rf"""WITH q AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark),
w AS (SELECT doc_id, source, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) > 4)) AS w FROM documents),
c AS (SELECT doc_id, source, w, row_number() OVER (PARTITION BY doc_id, source ORDER BY count(*) DESC, w) AS n FROM w GROUP BY doc_id, source, w QUALIFY n <= 5),
k AS MATERIALIZED (SELECT doc_id, source, list(w) AS keys FROM c GROUP BY doc_id, source),
s AS (SELECT item_id, doc_id, source, round(greatest(0, 1 - len(list_filter(keys, lambda x: contains(q, x))) / len(keys)), 3) AS distance FROM q, k WHERE len(keys) > 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id)::INT AS rank FROM s WHERE distance <= 0.8 QUALIFY rank <= 5)"""


def _plain_i(text: str) -> Column:
    """The dotted capital I as I, so that its lower case is the one letter that it is in the SQL."""
    return F.translate(text, "İ", "I")


def _keywords(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.filter(F.split(F.lower(_plain_i("text")), "[^a-z]+"), lambda w: F.length(w) > 4).alias("words"))
    counts = rows.select("chunk_id", "source_file", F.explode("words").alias("word")).groupBy("chunk_id", "source_file", "word").count()
    rank = F.row_number().over(Window.partitionBy("chunk_id", "source_file").orderBy(F.desc("count"), "word"))
    best = counts.withColumn("rank", rank).where("rank <= 5").groupBy("chunk_id", "source_file").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("best"))
    return best.select("chunk_id", "source_file", F.transform("best", lambda x: x["word"]).alias("keywords"))


def _hits(spark: SparkSession, root: str, filters: dict | None = None) -> DataFrame:
    cases = table(spark, root, "benchmark").select(F.col("item_id").alias("question_id"), _plain_i("text").alias("question"))
    return evaluation.keyword_hits(cases, _keywords(spark, root), 5, filters)


@query(f"{_HITS} SELECT item_id AS question_id, doc_id AS chunk_id, distance, rank FROM hits")
def keyword_retrieval(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root)


# A case expects the source of the document with its number; every fifth expects no context, and every eleventh fails technically.
@query(f"""{_HITS}, found AS (SELECT item_id, list(source) AS sources FROM hits GROUP BY item_id),
judged AS (SELECT b.item_id % 5 = 0 AS none, b.item_id % 11 = 0 AS error, CASE WHEN b.item_id % 5 = 0 THEN sources IS NULL ELSE coalesce(list_contains(sources, d.source), false) END AND b.item_id % 11 <> 0 AS passed
  FROM benchmark b LEFT JOIN found USING (item_id) LEFT JOIN documents d ON d.doc_id = b.item_id)
SELECT count(*) AS cases, round(avg(passed::INT) FILTER (NOT none), 6) AS recall, round(avg(passed::INT) FILTER (none), 6) AS no_context_accuracy, round(avg(passed::INT), 6) AS pass_rate, count(*) FILTER (error) AS errors FROM judged""")
def retrieval_eval(spark: SparkSession, root: str) -> DataFrame:
    corpus = table(spark, root, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"))
    hits = _hits(spark, root).join(corpus, "chunk_id").withColumn("article_id", F.lit(None).cast("string"))
    found = evaluation.retrieved_sources(hits)
    expected = corpus.select(F.col("chunk_id").alias("question_id"), F.col("source_file").alias("expected"))
    cases = table(spark, root, "benchmark").select(F.col("item_id").alias("question_id")).join(expected, "question_id", "left").join(found, "question_id", "left")
    judged = cases.withColumn("expect_no_context", F.col("question_id") % 5 == 0).withColumn("error", F.col("question_id") % 11 == 0)
    out = evaluation.summary(judged.withColumn("passed", evaluation.passed(F.col("expect_no_context"), F.col("expected"), F.col("sources"))))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("recall", "no_context_accuracy", "pass_rate")], "errors")


@query("""SELECT item_id AS question_id FROM benchmark WHERE item_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM documents WHERE CASE WHEN item_id % 3 = 1 THEN doc_id = item_id * 7 ELSE source = 'source' || item_id END)""")
def missing_sources(spark: SparkSession, root: str) -> DataFrame:
    """Expected sources, by article or by file, that the corpus doesn't have."""
    i = F.col("item_id")
    cases = table(spark, root, "benchmark").select(i.alias("question_id"), F.when(i % 3 == 1, (i * 7).cast("string")).when(i % 3 == 2, F.concat(F.lit("source"), i.cast("string"))).alias("expected_source"), F.when(i % 3 == 1, "article_id").otherwise("source_file").alias("expected_source_field"))
    corpus = table(spark, root, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("source_file"))
    return evaluation.sources_missing(cases, corpus).select("question_id")
