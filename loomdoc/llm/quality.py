"""Quality rules in DataFrame functions only: counts within a text, and line frequencies across documents.

Cross-document rule: lines are normalised (lower case, digits as 0, runs of white space as one space, trimmed) and hashed;
for every host the distinct documents with a line are counted, where byte-equal texts of a host are one document; lines
in more than `max_documents` documents of a host are removed, and documents of which less than `min_share` of the words
or less than `min_words` words stay are rejected as depleted. Limits are the same at every size.

The first pass keeps only numbers and line hashes of a text, so that no later shuffle has texts. Hashes have 64 bits.

Defined results: null and empty texts have no words and fail; a null host is a host of its own; null keys and repeated
rows are kept; lines without a word are never counted or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import OWN, let, text_or_empty, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent lines that are broadcast at most; with more of them the join shuffles.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that the text has twice or more.

    Windows are hashed; only texts with a repeated hash sort (hash, place) pairs. Places of repeated windows, in order,
    cover the next window words each, or as far as the next place.
    """
    size = F.size(tokens)

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        doubled = let(
            pairs,
            lambda p: F.filter(
                F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])),
                lambda x: x.isNotNull(),
            ),
        )
        return F.array_sort(doubled)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places(hashes), covered))

    # one hash per word, then a hash per window of eight of them
    windows = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), size - window + 1), lambda i: F.xxhash64(F.slice(h, i, window))))
    return F.when(size < window + 1, F.lit(0)).otherwise(let(windows, count)).cast("long")


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]", "0"), f"[{SPACE}]+", " ")))


def features(text: Column) -> dict[str, Column]:
    """Counts of one text by name, and its lines as (hash, words)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    tokens = words(text)
    bare = F.translate(text, SPACE, "")
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(tokens, lambda t: repeated_words(t)),
        "lines": F.transform(lines, lambda x: let(normalised(x), lambda n: F.struct(F.xxhash64(n).alias("hash"), (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).cast("int").alias("words")))),
    }


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def quality(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = 50, min_share: float = 0.3, min_words: int = 20) -> DataFrame:
    """A row per row of `documents`: key, the counts, base_failed, frequent_lines (hashes), n_removed_words, kept."""
    body = text_or_empty(text)
    counted = documents.select(F.col(key).alias("key"), F.col(host).alias("host"), F.xxhash64(body).alias("hash"), *[c.alias(n) for n, c in features(body).items()])
    counted = written(counted, "quality-counts")
    own = counted.select("host", "hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("line"))
    frequent = own.groupBy("host", "line").agg(F.count_distinct("hash").alias("documents")).where(F.col("documents") > max_documents)
    frequent = written(frequent.select(F.col("host").alias(OWN + "host"), F.col("line").alias(OWN + "line")), "quality-frequent")
    side = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    hit = own.join(side, own["host"].eqNullSafe(side[OWN + "host"]) & (own["line"] == side[OWN + "line"]))
    removed = hit.groupBy("host", "hash").agg(F.collect_set("line").alias("frequent_lines"))
    removed = written(removed.select(F.col("host").alias(OWN + "host"), F.col("hash").alias(OWN + "hash"), "frequent_lines"), "quality-removed")
    both = counted.join(removed, counted["host"].eqNullSafe(removed[OWN + "host"]) & (counted["hash"] == removed[OWN + "hash"]), "left")
    gone = F.coalesce(F.aggregate(F.filter("lines", lambda x: F.array_contains("frequent_lines", x["hash"])), F.lit(0), lambda a, x: a + x["words"]), F.lit(0)).cast("long")
    left = F.col("n_words") - F.col("n_removed_words")
    out = both.withColumn("n_removed_words", gone).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words")))
    return out.select(F.col("key").alias(key), F.col("host").alias(host), "hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("frequent_lines", F.array().cast("array<bigint>")).alias("frequent_lines"), "n_removed_words", "kept")


def cleaned(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept rows of `documents`, their texts without the frequent lines."""
    found = quality(documents, key, text, host, **limits).where("kept").select(F.col(key).alias(OWN + "key"), F.col(host).alias(OWN + "host"), F.col("hash").alias(OWN + "hash"), F.col("frequent_lines").alias(OWN + "lines"))
    found = found.dropDuplicates([OWN + "key", OWN + "host", OWN + "hash"])
    same = documents[key].eqNullSafe(found[OWN + "key"]) & documents[host].eqNullSafe(found[OWN + "host"]) & (F.xxhash64(text_or_empty(documents[text])) == found[OWN + "hash"])
    stay = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(OWN + "lines", F.xxhash64(normalised(x))))
    return documents.join(found, same).withColumn(text, F.when(F.size(OWN + "lines") == 0, F.col(text)).otherwise(F.array_join(stay, "\n"))).select(*documents.columns)
