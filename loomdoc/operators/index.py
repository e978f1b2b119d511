"""The chunk index: content hashes, reuse of embeddings, what to write and delete, integrity, clean-up, versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions import text as t

PARSER_VERSION, EMBEDDING_MODEL = "structure-v2", "nomic-embed-text"
STABLE = ("block_type", "heading_path", "page_number", "row", "sheet", "slide_number")  # in the order of their names
NUMBERS = ("page_number", "slide_number")


def content_hash(document_id: Column, content: Column, metadata: Column, parser: str = PARSER_VERSION, model: str = EMBEDDING_MODEL) -> Column:
    """SHA-256 of canonical JSON: sorted keys, ", " and ": ", non-ASCII kept, null metadata left out."""
    value = lambda k: metadata[k] if k in NUMBERS else t.json_string(metadata[k])
    pairs = F.array(*[F.when(metadata[k].isNotNull(), F.concat(F.lit(f'"{k}": '), value(k))) for k in STABLE])
    inner = F.array_join(F.filter(pairs, lambda x: x.isNotNull()), ", ")
    text = F.concat(F.lit('{"content": '), t.json_string(t.collapse(content)), F.lit(', "document_id": '), t.json_string(document_id), F.lit(f', "embedding_model": "{model}", "metadata": {{'), inner, F.lit(f'}}, "parser_version": "{parser}"}}'))
    return F.sha2(text.cast("binary"), 256)


def prepared(chunks: DataFrame, article: str = "article_id", document: str = "document_id") -> DataFrame:
    """Chunks (article, document, chunk, content, metadata) with hash, id and dense index; repeated contents of an article once."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col(document), F.col("content"), F.col("metadata")))
    first = F.row_number().over(Window.partitionBy(article, "content_hash").orderBy("chunk"))
    kept = hashed.withColumn("first", first).where("first = 1").drop("first")
    index = F.row_number().over(Window.partitionBy(article).orderBy("chunk")) - 1
    return kept.withColumn("chunk_index", index).withColumn("chunk_id", F.concat(F.col(article).cast("string"), F.lit(":"), F.left("content_hash", F.lit(32))))


@dataclass(frozen=True)
class Delta:
    """What a new version of some articles' chunks asks of the index."""

    to_embed: DataFrame
    reused: DataFrame
    to_delete: DataFrame


def delta(index: DataFrame, new: DataFrame, article: str = "article_id", touched: DataFrame | None = None) -> Delta:
    """Embeddings are reused by content hash within the article; ids that the new chunks don't have are stale.

    Only `touched` articles (a column of their ids; those of the new chunks where it isn't given) change; a touched article
    without new chunks loses all it had. Both tables are read three times: give written ones.
    """
    ids = (new if touched is None else touched).select(article).distinct()
    old = index.join(ids, article, "left_semi")
    known = old.groupBy(article, "content_hash").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    matched = new.join(known, [article, "content_hash"], "left")
    return Delta(matched.where("embedding is null").drop("embedding"), matched.where("embedding is not null"), old.join(new, "chunk_id", "left_anti").select(article, "chunk_id"))


def applied(index: DataFrame, change: Delta, embedded: DataFrame) -> DataFrame:
    """The index after the change; `embedded` is to_embed with embeddings."""
    new = change.reused.unionByName(embedded)
    kept = index.join(change.to_delete, "chunk_id", "left_anti").join(new, "chunk_id", "left_anti")
    return kept.unionByName(new.select(*index.columns))


def orphans(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks of articles that aren't there."""
    return chunks.where("trim(article_id) <> ''").join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def stale(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks whose text their article doesn't have any more (suspects, never deleted); blank ones aren't looked at."""
    now = articles.select(F.col("id").alias("article_id"), F.col("content").alias("article_content"))
    text = t.strip(F.coalesce("text", F.lit("")))
    return chunks.join(now, "article_id").where((text != "") & ~F.contains(F.coalesce("article_content", F.lit("")), text)).drop("article_content")


def integrity(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """A row per chunk with its problem: empty_metadata, missing_both_fields, orphan, stale or null; the first one counts.

    chunks: chunk_id, has_metadata, article_id, source_file, text.
    """
    now = articles.select(F.col("id").alias("article_id"), F.col("content").alias("article_content"), F.lit(True).alias("there"))
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    text = t.strip(F.coalesce("text", F.lit("")))
    problem = (
        F.when(~F.col("has_metadata"), "empty_metadata")
        .when(~named("article_id") & ~named("source_file"), "missing_both_fields")
        .when(named("article_id") & F.col("there").isNull(), "orphan")
        .when(named("article_id") & (text != "") & ~F.contains(F.coalesce("article_content", F.lit("")), text), "stale")
    )
    return chunks.join(now, "article_id", "left").withColumn("problem", problem).drop("there", "article_content")


def report(checked: DataFrame) -> DataFrame:
    """One row: chunks in all and by problem."""
    return checked.agg(F.count("*").alias("total_chunks"), *[F.count_if(F.col("problem") == p).alias(p) for p in ("empty_metadata", "missing_both_fields", "orphan", "stale")])


def cleaned(chunks: DataFrame, checked: DataFrame) -> DataFrame:
    """Chunks without the broken and orphaned ones; stale suspects stay."""
    return chunks.join(checked.where(F.col("problem").isin("empty_metadata", "missing_both_fields", "orphan")).select("chunk_id"), "chunk_id", "left_anti")


def without(chunks: DataFrame, article_id: str | None = None, source_file: str | None = None) -> tuple[DataFrame, int]:
    """The chunks without those of an article and of a file, and how many those are."""
    gone = F.lit(False)
    for column, value in (("article_id", article_id), ("source_file", source_file)):
        if value is not None:
            gone = gone | F.coalesce(F.col(column).cast("string") == require_id(value), F.lit(False))
    return chunks.where(~gone), chunks.where(gone).count()


def listed(checked: DataFrame, most: int = 20) -> DataFrame:
    """Problems by name: their ids in order, the first `most` of them and how many more there are."""
    found = checked.where("problem is not null").select("problem", "chunk_id")
    # the filter limits every task's rows before they meet
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("problem").orderBy("chunk_id"))).where(F.col("nth") <= most)
    some = first.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))).alias("some"))
    rows = found.groupBy("problem").agg(F.count("*").alias("chunks")).join(some, "problem").select("problem", "chunks", F.array_join(F.transform("some", lambda x: x["chunk_id"]), ", ").alias("ids"))
    more = F.when(F.col("chunks") > most, F.concat(F.lit("... and "), (F.col("chunks") - most).cast("string"), F.lit(" more")))
    return rows.select("problem", "chunks", F.concat_ws(" ", "ids", more).alias("sample")).orderBy("problem")


def require_id(value: str) -> str:
    if not value or not value.strip():
        raise ValueError("a non-blank id is needed")
    return value


class VersionedTable:
    """A parquet table of numbered versions: a new one is written beside the old, then the pointer changes.

    Every write has a folder of its own, which its version's pointer names; of two writers of a version, the one whose
    pointer is second gets an error. A failed write leaves the pointers as they were: the old version is the snapshot to
    go back to.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, self._fs = hadoop.Path, hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/current-{version}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        if not self._fs.exists(self._path(self.path)):
            return []
        found = self._fs.listStatus(self._path(self.path))
        return sorted(int(s.getPath().getName()[8:]) for s in found if s.getPath().getName().startswith("current-") and s.getLen())

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{self._folder(version or found[-1])}")

    def write(self, df: DataFrame) -> int:
        """A new version; creating its pointer is atomic."""
        version = (self.versions() or [0])[-1] + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._point(version, folder)

    def _point(self, version: int, text: str) -> int:
        pointer = self._fs.create(self._path(f"{self.path}/current-{version}"), False)
        pointer.write(bytearray(text.encode()))
        pointer.close()
        return version

    def rollback(self) -> int:
        """Back to the version before."""
        found = self.versions()
        if len(found) < 2:
            raise ValueError("no version to go back to")
        self._fs.delete(self._path(f"{self.path}/current-{found[-1]}"), False)
        return found[-2]
