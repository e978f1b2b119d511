"""Structured Streaming around the batch operators: files that arrive become chunks, questions become log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomdoc.operators.articles import QA_LOG
from loomdoc.operators.chunkers import chunk_documents
from loomdoc.sources.office import accepted, to_markdown
from loomdoc.functions import text as t

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Convert and chunk what arrives in a folder; each micro-batch is appended once, under its number.

    Below `target`: documents (the Markdown, from which the chunkers read), chunks, and rejected (files that are too large,
    of no known format or broken, with the reason).
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(source)
    files = stream.select("path", t.basename(F.col("path")).alias("source_file"), t.extension(F.col("path")).alias("ext"), F.sha2("content", 256).alias("document_id"), "length", "content")

    def write(batch: DataFrame, number: int) -> None:
        part = lambda name: f"{target}/{name}/batch={number}"
        good, bad = accepted(batch)
        to_markdown(good, "path").write.mode("overwrite").parquet(part("documents"))
        made = spark.read.parquet(part("documents"))
        failed = made.where("error is not null").select("path", "source_file", "document_id", F.col("error").alias("reason"))
        failed.unionByName(bad.select("path", "source_file", "document_id", "reason")).write.mode("overwrite").parquet(part("rejected"))
        documents = made.where("error is null").withColumnRenamed("document_id", "doc_id")
        chunk_documents(documents).write.mode("overwrite").parquet(part("chunks"))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_answers(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Question-log rows (JSON lines) appended to a parquet table."""
    stream = spark.readStream.schema(QA_LOG).json(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_rates(logs: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Questions per window, late rows up to the watermark; for batch and streaming frames alike."""
    return logs.withWatermark("created_at", late).groupBy(F.window("created_at", window)).agg(F.count("*").alias("questions"))


__all__ = ["ingest_files", "log_answers", "question_rates"]
