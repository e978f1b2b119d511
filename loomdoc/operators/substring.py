"""Searches for parts of texts by an index of trigrams: posting lists are intersected before any text is looked at.

A posting list has the numbers of the rows whose text, in lower case A-Z, has a trigram. It is cut into blocks of 65,536
numbers, so that a trigram that all texts have is many rows of bounded size; a block's numbers are sorted, and files keep
the steps between them. A term is a LIKE pattern without its outer wildcards, as `functions.text.like_ascii_ci` has it:
% and _ stand for any characters, a backslash for itself. A text that a term matches has all trigrams of the term's pieces
between wildcards; rows whose numbers stand in all of these lists are candidates, and only they meet the LIKE test.
Terms whose pieces are all shorter than three characters have no trigram: they are tested on every row.

Defined results: null texts match nothing; an empty term matches every other text; equal terms and equal texts are found each; a null
term matches nothing. Row numbers are keys of whole numbers that name a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.text import let
from loomdoc.session import scratch

GRAM, BITS = 3, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none of a shorter one."""

    def of(chars: Column) -> Column:
        places = F.when(F.size(chars) >= GRAM, F.sequence(F.lit(0), F.size(chars) - GRAM)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))

    return F.array_distinct(let(F.split(text, ""), of))


def term_grams(term: Column) -> Column:
    """The distinct trigrams that a match of the term has."""
    return F.array_distinct(F.flatten(F.transform(F.split(_lower(F.trim(term)), "[%_]"), grams)))


def index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The posting lists (gram, block, low), written: sorted by trigram, so that files and row groups of others are skipped.

    The files keep a list's sorted numbers as packed steps from one to the next.
    """
    # outer: of an inner explode Spark infers a filter, which makes every text's trigrams once more
    held = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.explode_outer(grams(_lower(F.col(text)))).alias("gram")).where("gram is not null")
    block, low = F.shiftright("key", BITS), F.col("key").bitwiseAND((1 << BITS) - 1).cast("int")
    lists = held.groupBy("gram", block.alias("block")).agg(F.array_sort(F.collect_set(low)).alias("low"))
    path = scratch(rows.sparkSession, "trigrams")
    packed = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.options(**packed).parquet(path)
    return rows.sparkSession.read.schema(lists.schema).parquet(path)


def candidates(postings: DataFrame, terms: DataFrame, term_key: str, term: str) -> DataFrame:
    """Rows (term_key, key) that have all trigrams of a term; terms without trigrams have none."""
    asked = terms.select(term_key, F.size(term_grams(F.col(term))).alias("needed"), F.explode(term_grams(F.col(term))).alias("gram"))
    lists = asked.join(postings, "gram").groupBy(term_key, "needed", "block").agg(F.collect_list(F.struct(F.size("low").alias("n"), "low")).alias("lists"))
    # a block that lacks one of the trigrams has no candidate; the shortest list comes first
    full = lists.where(F.size("lists") == F.col("needed")).withColumn("lists", F.array_sort("lists"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0]["low"], lambda a, x: F.array_intersect(a, x["low"]))
    key = F.shiftleft("block", BITS) + F.col("low")
    return full.select(term_key, "block", F.explode(both).alias("low")).select(term_key, key.alias("key"))


def pattern(term: Column) -> Column:
    """The LIKE pattern of a term."""
    return F.concat(F.lit("%"), F.replace(_lower(F.trim(term)), F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def search(postings: DataFrame, rows: DataFrame, key: str, text: str, terms: DataFrame, term_key: str, term: str) -> DataFrame:
    """Columns term_key, key of every row that a term matches. terms: term_key names a term."""
    asked = terms.where(F.col(term).isNotNull()).select(term_key, term)
    found = candidates(postings, asked, term_key, term).join(asked.select(term_key, pattern(F.col(term)).alias("pattern")), term_key)
    texts = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), _lower(F.col(text)).alias("text"))
    likes = lambda df: df.where(F.expr("text LIKE pattern")).select(term_key, F.col("key").alias(key))
    out = likes(found.join(texts, "key"))
    short = asked.where(F.size(term_grams(F.col(term))) == 0).select(term_key, pattern(F.col(term)).alias("pattern"))
    if not short.limit(1).count():
        return out
    # a stated set of terms against all rows, as a scan is
    return out.unionByName(likes(texts.join(short, F.expr("text LIKE pattern"))))
