"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rows are repeated so often, in the mean, that the sources' shares of the output are the target weights: the
mean of a row is weight * total / rows of the source. A row's count inverts the Poisson distribution with that mean at a
uniform number from a hash of seed, key and text; the row is exploded by the count and the copies are put in the order
of another hash, over all partitions. Only a count per source is gathered before, with partial sums.

A source's distribution is one array of partial sums, made once per source; a row's count is the number of them that its
uniform number reaches. The sources' table is broadcast where its measured size is under `BROADCAST_BYTES`; beyond, rows
and sources are joined by source and one of `SALTS` salts, so that a hot source is many tasks. Copies go straight to the
partition of their hash, whose bounds are known beforehand as it is uniform, and are sorted there: no pass samples them.

Means over `PART` are split into equal parts with a uniform number each, as a sum of Poisson numbers is one. Hashes are
md5, of which the first 52 bits are an exact double.

Defined results: a null source is a source of its own, which a target names by None; sources without a target have weight
0 and go where targets are given; null keys and texts hash as empty; repeated rows get the same count; no rows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import OWN, let, text_or_empty, written

PART = 16.0
#: Measured bytes of the sources' table (names and distributions) up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A uniform double in [0, 1) from md5 of the parts as text, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column, most: int) -> Column:
    """The partial sums P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as a number under 1 can reach them."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + p)).alias("sums"))

    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(most - 1)), start, step)["sums"], lambda x: x < 1)


def poisson(sums: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u: how many partial sums u reaches."""
    return let(u, lambda v: F.size(F.filter(sums, lambda x: v >= x)))


def means(
    documents: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, total: int | None = None
) -> DataFrame:
    """A row per source: source, rows, mean. Without weights all sources weigh the same; without total, rows stay as many."""
    counts = documents.groupBy(F.col(source).alias(OWN + "source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col(OWN + "source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    whole = counts.agg(F.sum("rows").alias("n"), F.sum("weight").alias("all")).first()  # two numbers
    size = float(total if total is not None else whole["n"] or 0)
    scale = size / whole["all"] if whole["all"] else 0.0
    return counts.select(OWN + "source", "rows", (F.col("weight") * scale / F.col("rows")).alias(OWN + "mean"))


def _with_rates(documents: DataFrame, rates: DataFrame, key: str, text: str, source: str, most_bytes: int) -> DataFrame:
    """Rows with the columns of their source's rates; the join shuffles only where the rates are too large to broadcast."""
    name = F.octet_length(F.coalesce(F.col(OWN + "source").cast("string"), F.lit("")))
    measured = rates.agg(F.coalesce(F.sum(name + 8 * F.size(OWN + "sums") + 64), F.lit(0))).first()[0]
    same = documents[source].eqNullSafe(rates[OWN + "source"])
    if measured <= most_bytes:
        return documents.join(F.broadcast(rates), same)
    salted = rates.withColumn(OWN + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = documents.withColumn(OWN + "salt", F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows[source].eqNullSafe(salted[OWN + "source"]) & (rows[OWN + "salt"] == salted[OWN + "salt"])).drop(OWN + "salt")


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str | None, float] | None = None,
    total: int | None = None,
    seed: int = 42,
    most: int = 60,
    copy: str = "copy",
    order: str = "shuffle_key",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`documents`, each row as often as its count says, with its copy number (from 0), in the order of a hash.

    `most` ends the inversion: 16 (PART) is the largest mean of a part, and a Poisson number of it is over 60 with a
    probability under 1e-16. Partition i of n has the hashes from i / n to (i + 1) / n in order, so that partitions one
    after the other are in order too.
    """
    mean = F.col(OWN + "mean")
    parts = F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")
    rates = means(documents, source, weights, total).select(OWN + "source", mean, parts.alias(OWN + "parts"))
    rates = rates.select(OWN + "source", OWN + "parts", distribution(mean / F.col(OWN + "parts"), most).alias(OWN + "sums"))
    rows = _with_rates(documents, written(rates, "mixing-rates"), key, text, source, broadcast_bytes)
    counted = rows.withColumn(OWN + "name", F.md5(text_or_empty(text).cast("binary")))
    draw = lambda j: poisson(F.col(OWN + "sums"), uniform(F.lit(seed), F.col(key), F.col(OWN + "name"), j))
    draws = F.transform(F.sequence(F.lit(1), OWN + "parts"), draw)
    counted = counted.withColumn(OWN + "n", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    # an empty array ends a row without copies: a filter on the count would have it computed twice
    nth, place = OWN + "nth", OWN + "place"
    copies = counted.select("*", F.posexplode(F.array_repeat(F.lit(True), F.col(OWN + "n"))).alias(nth, OWN + "one"))
    placed = copies.withColumn(place, uniform(F.lit(f"{seed}-order"), F.col(key), F.col(OWN + "name"), F.col(nth)))
    spread = placed.select(*documents.columns, nth, place)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartitionById(partitions, F.floor(F.col(place) * partitions).cast("int")).sortWithinPartitions(place)
    taken = [c.lower() for c in documents.columns]
    named = {}
    for name, wanted in ((nth, copy), (place, order)):
        while wanted.lower() in taken:
            wanted += "_"
        taken.append(wanted.lower())
        named[name] = wanted
    return spread.withColumnsRenamed(named)
