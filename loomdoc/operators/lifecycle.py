"""Articles and their index kept together: ingest, create, update, delete; what fails in between is undone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators import articles as a
from loomdoc.operators import index as ix
from loomdoc.operators.chunkers import chunk_documents
from loomdoc.operators.splitting import ChunkConfig
from loomdoc.sources import office

#: From chunks without embeddings (a `content` column) to the same with a column `embedding`.
Embedder = Callable[[DataFrame], DataFrame]
INDEX = "article_id string, document_id string, source_file string, chunk_id string, chunk_index int, content string, metadata map<string,string>, content_hash string, embedding array<double>"


class IndexingError(RuntimeError):
    """The index couldn't follow the articles; both are what they were."""


def chunked(articles: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Prepared chunks of articles: INDEX without the embedding."""
    named = articles.select(F.col("id").alias("article_id"), "document_id", "source_file")
    made = chunk_documents(articles.select(F.col("id").alias("article_id"), "source_file", F.col("content").alias("markdown")), "article_id", config)
    ready = ix.prepared(made.join(named, "article_id"))
    return ready.select("article_id", "document_id", "source_file", "chunk_id", "chunk_index", "content", "metadata", "content_hash")


def empty_articles(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Articles without a chunk and without text, which are an error; those with text only lose their old chunks."""
    blank = t.strip(F.coalesce("content", F.lit(""))) == ""
    return articles.where(blank).join(chunks.select(F.col("article_id").alias("id")), "id", "left_anti")


def changed_index(index: DataFrame, chunks: DataFrame, touched: DataFrame, embed: Embedder) -> DataFrame:
    """The index after the touched articles' chunks are these: equal contents keep their embedding, others are embedded."""
    change = ix.delta(index, chunks, touched=touched)
    return ix.applied(index, change, embed(change.to_embed))


@dataclass
class Library:
    """Articles and index as versioned tables below a folder, with an embedder."""

    spark: SparkSession
    path: str
    embed: Embedder
    config: ChunkConfig = ChunkConfig()
    keep: Callable[[DataFrame, str], DataFrame] | None = None  # writes a table that is read again and again
    articles: ix.VersionedTable = field(init=False)
    index: ix.VersionedTable = field(init=False)

    def __post_init__(self) -> None:
        self.articles = ix.VersionedTable(self.spark, f"{self.path}/articles")
        self.index = ix.VersionedTable(self.spark, f"{self.path}/index")
        if not self.articles.versions():
            self.articles.write(self.spark.createDataFrame([], a.ARTICLE))
        if not self.index.versions():
            self.index.write(self.spark.createDataFrame([], INDEX))

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table below the library's folder, computed once."""
        if self.keep:
            return self.keep(df, name)
        staged = ix.VersionedTable(self.spark, f"{self.path}/staged-{name}")
        staged.write(df)
        return staged.read()

    def commit(self, articles: DataFrame, touched: DataFrame) -> None:
        """Articles and then the index get a new version; where the index fails, the articles go back.

        touched: ids (a column `id`) of the articles that are new, changed or gone. Chunks and embeddings are computed
        before the first write.
        """
        touched = self._kept(touched.select(F.col("id").alias("article_id")).distinct(), "touched")
        now = self._kept(articles, "articles")
        changed = now.join(touched.select(F.col("article_id").alias("id")), "id", "left_semi")
        chunks = self._kept(chunked(changed, self.config), "chunks")
        empty = empty_articles(changed, chunks).select("id").limit(1).collect()
        if empty:
            raise ValueError(f"article {empty[0][0]} has neither chunks nor text")
        try:
            after = self._kept(changed_index(self.index.read(), chunks, touched, self.embed), "index")
        except Exception as e:
            raise IndexingError(str(e)[:300]) from e
        self.articles.write(now)
        try:
            self.index.write(after)
        except Exception as e:
            self.articles.rollback()
            raise IndexingError(str(e)[:300]) from e

    def create(self, new: DataFrame) -> None:
        """New articles; a document_id that is there already is an error."""
        self.commit(a.insert(self.articles.read(), new), new)

    def update(self, changes: DataFrame, now: Column) -> None:
        """Fields of articles, where the changes aren't null."""
        self.commit(a.update(self.articles.read(), changes, now), changes)

    def upsert(self, new: DataFrame) -> None:
        """Articles by document_id: those that are there keep their id."""
        after = self._kept(a.upsert(self.articles.read(), new), "upsert")
        self.commit(after, after.join(new.select("document_id"), "document_id", "left_semi"))

    def delete(self, ids: DataFrame, assets: str | None = None) -> int:
        """Articles, their chunks, and the folders of their documents below `assets`, if that can be done; how many articles went."""
        stays, gone = a.delete(self.articles.read(), ids)
        gone = self._kept(gone, "gone")
        self.commit(stays, gone)
        if assets is not None:
            gone.select("document_id").foreachPartition(lambda rows: [remove_assets(assets, r[0]) for r in rows])
        return gone.count()

    def ingest(self, files: DataFrame, now: Column) -> DataFrame:
        """Files (office.read_files) as articles and chunks; the result are those that couldn't be taken, with the reason.

        The document's id is the digest of its bytes, so that a file that comes again changes nothing.
        """
        rows, rejected = converted(files)
        rows, rejected = self._kept(rows, "converted"), self._kept(rejected, "rejected")
        made = rows.dropDuplicates(["document_id"]).select(F.expr("uuid()").alias("id"), "document_id", t.stem(F.col("source_file")).alias("title"), F.col("markdown").alias("content"), "source_file", now.alias("created_at"), now.alias("updated_at"))
        self.upsert(self._kept(made, "made"))
        return rejected

    def seed(self, corpus: DataFrame, now: Column) -> None:
        """A corpus (id, article_id, source_file, source_url, text) as articles under its article_id; all of it has to be there after."""
        rows = corpus.select(F.col("article_id").alias("id"), F.sha2(F.concat_ws("\x1f", "id", "text"), 256).alias("document_id"), F.col("source_file").alias("title"), F.col("text").alias("content"), "source_file", now.alias("created_at"), now.alias("updated_at"))
        before = self.articles.read().join(rows.select("id"), "id", "left_anti")
        self.commit(before.unionByName(rows), rows)
        lost = missing_ids(self.index.read(), rows.select(F.col("id").alias("article_id"))).limit(1).collect()
        if lost:
            raise IndexingError(f"article {lost[0][0]} isn't in the index")


def missing_ids(index: DataFrame, wanted: DataFrame, key: str = "article_id") -> DataFrame:
    """Wanted keys that the index doesn't have."""
    return wanted.select(key).distinct().join(index.select(key), key, "left_anti")


def converted(files: DataFrame, most: int = office.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files as Markdown (document_id, source_file, markdown), and the others (path, source_file, document_id, reason)."""
    good, bad = office.accepted(files, most)
    made = office.to_markdown(good, "path")
    failed = made.where("error is not null").select("path", "source_file", "document_id", F.col("error").alias("reason"))
    return made.where("error is null").select("document_id", "source_file", "markdown"), failed.unionByName(bad.select("path", "source_file", "document_id", "reason"))


def remove_assets(folder: str, document_id: str) -> bool:
    """Delete the document's own folder; whatever isn't a plain name below `folder` is left alone, and so is what can't be deleted."""
    from pyarrow import fs

    if not document_id or document_id in (".", "..") or any(c in document_id for c in "/\\\0"):
        return False
    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root.rstrip('/')}/{document_id}"
    try:
        if store.get_file_info(path).type != fs.FileType.Directory:
            return False
        store.delete_dir(path)
    except OSError:
        return False
    return True
