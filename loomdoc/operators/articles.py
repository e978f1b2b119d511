"""Articles and question logs as tables: lookups, pages of the list, changes that return rows, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import text as t
from loomdoc.session import stored

ARTICLE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("id", "document_id", "title", "content", "source_file")] + [T.StructField(c, T.TimestampType(), False) for c in ("created_at", "updated_at")])
SOURCE = T.StructType([T.StructField("text", T.StringType()), T.StructField("article_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("distance", T.DoubleType())])
QA_LOG = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("question", T.StringType(), False), T.StructField("answer", T.StringType(), False), T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("created_at", T.TimestampType(), False)])


class DuplicateDocumentError(ValueError):
    """A document_id that the table has."""


def by_id(articles: DataFrame, value: str, column: str = "id") -> DataFrame:
    return articles.where(F.col(column) == value)


def list_page(articles: DataFrame, skip: int = 0, limit: int = 20, search: str | None = None, order: str = "id") -> DataFrame:
    """A page of the list: skip at 0 at least, limit within 1 to 100; a search term is looked for in titles."""
    rows = articles.where(t.like_ascii_ci(F.col("title"), search)) if search and search.strip() else articles
    return rows.orderBy(order).offset(max(0, skip)).limit(max(1, min(100, limit)))


def page_with_next(articles: DataFrame, skip: int, limit: int, order: str = "id") -> DataFrame:
    """A page and, in has_next, whether another one follows: one more row is looked at."""
    some = list_page(articles, skip, limit, order=order) if limit >= 100 else list_page(articles, skip, limit + 1, order=order)
    at = F.row_number().over(Window.orderBy(order))  # over one page
    return some.withColumn("at", at).withColumn("has_next", F.max("at").over(Window.partitionBy()) > limit).where(F.col("at") <= limit).drop("at")


def duplicates(articles: DataFrame, key: str = "document_id") -> DataFrame:
    """Values of a key that should be unique, with how often they stand there."""
    return articles.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def insert(articles: DataFrame, new: DataFrame) -> DataFrame:
    """Both; an error if a new document_id is there already."""
    twice = new.join(articles, "document_id", "left_semi").select("document_id").unionAll(duplicates(new).select("document_id")).limit(1).collect()
    if twice:
        raise DuplicateDocumentError(twice[0][0])
    return articles.unionByName(new)


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with an id and the times of now."""
    return rows.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def update(articles: DataFrame, changes: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Articles with the changes' non-null values; changed ones get the time `now`."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key], F.lit(True).alias("changed"))
    rows = articles.join(new, key, "left")
    values = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in changes.columns if c != key}
    values["updated_at"] = F.when(F.col("changed"), now).otherwise(F.col("updated_at"))
    return rows.withColumns(values).select(*articles.columns)


def upsert(articles: DataFrame, new: DataFrame, key: str = "document_id", kept: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """A full outer merge on the key: new rows win, but those that were there keep `kept`."""
    a, b = articles.alias("a"), new.alias("b")
    both = a.join(b, key, "full_outer")
    value = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in kept else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return both.select(*[F.col(key) if c == key else value(c).alias(c) for c in articles.columns])


def last_writes(writes: DataFrame, key: str, order: str) -> DataFrame:
    """Of several writes of a key, the last; id and created_at of the first."""
    rows = writes.groupBy(key).agg(F.max_by(F.struct(*[c for c in writes.columns if c != key]), order).alias("last"), F.min_by("id", order).alias("first_id"), F.count("*").alias("writes"))
    return rows.select(key, F.col("first_id").alias("id"), *[F.col(f"last.{c}") for c in writes.columns if c not in (key, "id")], "writes")


def delete(articles: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """What stays, and what was deleted."""
    return articles.join(ids, key, "left_anti"), articles.join(ids, key, "left_semi")


def appended(log: DataFrame, new: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The log with new rows behind it: their ids go on from its largest one, in the given order.

    Numbers are dealt by sorted ranges of rows, so that no task has all of them. The ranges are written: planned twice, for
    their sizes and for their rows, they need not be the same ones.
    """
    last = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("last"))  # one row
    ranges = new.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "appended")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    rows = parts.join(F.broadcast(before), "part").crossJoin(F.broadcast(last)).withColumn(key, F.col("last") + F.col("before") + F.col("at") - F.col("first") + 1)
    return log.unionByName(rows.select(*log.columns))


def migrated(logs: DataFrame) -> DataFrame:
    """Old logs had one `source`, new ones a list `sources`: filled from it where it is null or empty. Idempotent."""
    if "sources" not in logs.columns:
        logs = logs.withColumn("sources", F.lit(None).cast("string"))
    if "source" not in logs.columns:
        return logs
    return logs.withColumn("sources", F.when(F.col("sources").isNull() | (F.col("sources") == "[]"), F.col("source")).otherwise(F.col("sources"))).drop("source")


def statistics(articles: DataFrame, logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of three counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    named = [one(articles, "total_articles"), one(logs, "total_questions"), one(chunks, "total_chunks")]
    rows = [d.select(F.lit(d.columns[0]).alias("name"), F.col(d.columns[0]).alias("n")) for d in named]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).groupBy().pivot("name", [d.columns[0] for d in named]).agg(F.max("n"))


def valid_question(question: Column) -> Column:
    return F.length(question) >= 5


def valid_search(query: Column) -> Column:
    return F.length(t.strip(query)) >= 2
