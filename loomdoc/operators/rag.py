"""Prompt, history and citations of answers that rest on retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomdoc.functions import text as t

HISTORY = 6
#: Phrases of an answer that says there is nothing, and the answer that stands for it.
REFUSALS = ("Tôi không tìm thấy", "không có thông tin")
REFUSAL = "Tôi không tìm thấy thông tin này trong tài liệu."
NO_HISTORY = "Không có"


def rendered(fields: dict[str, Column]) -> Column:
    """`name : value` lines, nulls as None."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k} : "), F.coalesce(c.cast("string"), F.lit("None"))) for k, c in fields.items()])


def context_rows(hits: DataFrame, fields: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Hits with label and context block, in order; those of one question, or of each where `by` names it."""
    at = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))
    rows = hits.withColumn("label", at)
    return rows.withColumn("context", F.concat(F.lit("[S"), F.col("label").cast("string"), F.lit("] "), rendered({f: F.col(f) for f in fields})))


def ask(questions: DataFrame, hits: DataFrame, generate: Callable[[Column], Column], system: str, fields: list[str], source: str = "chunk_id") -> DataFrame:
    """Questions (question_id, question, history) with cleaned answer, sources, labels and no_answer_reason.

    A question without hits gets the refusal, and no prompt of it is generated from. generate: prompt to answer, as a
    column; `provider` makes one of a callable.
    """
    blocks = context_rows(hits, fields, ["rank"], ["question_id"])
    block = F.struct("label", "context", F.col(source).alias("source"))
    found = blocks.groupBy("question_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    rows = questions.join(found, "question_id", "left")
    context = F.array_join(F.transform("blocks", lambda b: b["context"]), "\n\n")
    chunks = F.transform("blocks", lambda b: b["source"])
    told = rows.where("blocks is not null").withColumn("prompt", prompt(system, context, F.col("history"), F.col("question"))).withColumn("chunks", chunks)
    answers = answered(told.withColumn("answer", generate(F.col("prompt")))).select("question_id", "cleaned", "sources", "labels", "no_answer_reason")
    kind = {f.name: f.dataType for f in answers.schema}
    silent = rows.where("blocks is null").select("question_id", F.lit(REFUSAL).alias("cleaned"), F.array().cast(kind["sources"]).alias("sources"), F.array().cast(kind["labels"]).alias("labels"), F.lit("insufficient_context").alias("no_answer_reason"))
    return answers.unionByName(silent)


def provider(answer: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A column function of a callable that answers a list of prompts."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(answer(prompts.tolist()), dtype=object)

    return run


def prompt(system: str, context: Column, history: Column, question: Column) -> Column:
    """The whole prompt; an empty history has a fixed text."""
    return F.concat_ws("\n\n", F.lit(system), context, F.when(F.coalesce(history, F.lit("")) == "", NO_HISTORY).otherwise(history), question)


def history_window(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", last: int = HISTORY) -> DataFrame:
    """Of the last messages of each conversation, those of user and assistant with text, trimmed. 0 keeps all."""
    at = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    rows = messages.withColumn("at", at)
    recent = rows.where(F.col("at") <= last) if last else rows
    kept = recent.where(F.col("role").isin("user", "assistant") & (t.strip(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("text", t.strip(F.col("text"))).drop("at")


def history_text(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    rows = messages.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line")))).alias("lines"))
    return rows.select(conversation, F.size("lines").cast("long").alias("messages"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def citations(answer: Column) -> Column:
    """Numbers of the labels [S#], each once, in the order of their first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def without_invalid(answer: Column, labels: Column, total: Column) -> Column:
    """The answer without the labels that no chunk has, and the space after them."""
    bad = F.filter(labels, lambda n: (n < 1) | (n > total))
    label = lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))
    return F.aggregate(bad, answer, lambda a, n: F.replace(F.replace(a, F.concat(label(n), F.lit(" ")), F.lit("")), label(n), F.lit("")))


def answered(rows: DataFrame, answer: str = "answer", chunks: str = "chunks") -> DataFrame:
    """Rows (answer, chunks array) with cleaned answer, labels, sources in the order of first citation, and no_answer_reason.

    An answer that refuses or cites no chunk is the fixed refusal, without sources.
    """
    labels = citations(F.col(answer))
    valid = F.filter("labels", lambda n: (n >= 1) & (n <= F.size(chunks)))
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(F.col(answer), F.lit(phrase))
    rows = rows.withColumn("labels", labels).withColumn("valid", valid).withColumn("refused", refused | (F.size("valid") == 0))
    none = F.slice(F.col(chunks), 1, 0)
    return (
        rows.withColumn("sources", F.when(F.col("refused"), none).otherwise(F.transform("valid", lambda n: F.get(chunks, n - 1))))
        .withColumn("labels", F.when(F.col("refused"), F.array().cast("array<int>")).otherwise(F.col("valid")))
        .withColumn("cleaned", F.when(F.col("refused"), REFUSAL).otherwise(without_invalid(F.col(answer), citations(F.col(answer)), F.size(chunks))))
        .withColumn("no_answer_reason", F.when(F.col("refused"), "insufficient_context"))
        .drop("valid", "refused")
    )
