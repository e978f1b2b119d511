"""Personal data: base kinds by their patterns, and unseen identifiers by bootstrapped contextual extraction.

Seeds are the base kinds' matches (email, ip, card, phone) and secrets of a sure shape (32 to 64 hexadecimal digits). The
two and the three lexical tokens before a seed are lexical patterns; those with `support` distinct seeds are counted in all
texts, and those of whose places a share of `least_share` has seeds are induced, so that what they extract grows as seeds
do. A third pass over all texts takes everything that fills the place after an induced pattern: what stands up to the next
white space, and where that has a digit or is a few capitals, all groups of digits and capitals behind it. Patterns, fillers and the fillers' shapes (runs
of small letters, capitals and digits as one sign each) then score each other in Spark for some rounds: a pattern by the
share of its fillers that identifiers make up, a shape likewise, and a filler by the patterns that it stands behind, all
its places counted, moved by how much more or less often its shape is an identifier than fillers are on the whole. So a
plain word needs a surer pattern than a number does, and no shape is ruled out. What scores `confidence` after a pattern
of that confidence is found, though no base kind matches it.

The later passes know the patterns and their last tokens by bitmaps of BITS bits, whose size doesn't depend on the data; a join on
the pattern itself follows, so that false hits of the bitmap only cost rows. Occurrences, not texts, are shuffled.

Defined results: null and empty texts have no spans; positions are code points; null keys and repeated rows are kept
and get the spans of their own text; extra columns aren't read. Spans of kinds that the method adds are `secret` and `found`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import OWN, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
BITS = 1 << 22
MEMORY = 500_000  # tokens that a task remembers of whether a pattern ends with them
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

# Possessive forms and anchors keep every search linear; they match what the plain patterns match, as no part of an
# address can begin in the middle of a run of its own characters unless the match before ended there.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"""[^\s"'<>,;()\[\]{}|=:]+|["'<>,;()\[\]{}|=:]""")
_DIGIT = re.compile("[0-9]")
_FILLER = re.compile(r"""[^\s"'<>,;\[\]{}|=]+""")
# groups with a digit, each with a group of capitals before it at most
_GROUPS = re.compile(r"(?: (?:[A-Z]{1,6}+ )?[(]?[A-Z]{0,6}+[0-9][0-9A-Z().\-/]*+)++(?![^\W\d_])")
_RUNS = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = at + 1  # no later local part reaches over this sign
        at = text.find("@", done)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base kinds, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Fa-f]", m[0])]


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _contexts(tokens: list[str], i: int) -> list[int]:
    """The patterns before token i: its two and its three tokens to the left."""
    return [_hash(*tokens[i - k : i]) for k in (2, 3) if i >= k]


_SEED = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("instance", T.LongType()), T.StructField("last", T.LongType())])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and, for every seed that begins a token, its patterns."""
    for batch in batches:
        spans, seeds = [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text) + secret_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
            own = []
            if found:
                at = {m.start(): i for i, m in enumerate(_TOKEN.finditer(text))}
                tokens = _TOKEN.findall(text.lower())
                for _, start, end in found:
                    if start in at:
                        i, instance = at[start], _signed(_hash(text[start:end].lower()))
                        own += [{"pattern": _signed(p), "instance": instance, "last": _signed(_hash(tokens[i - 1]))} for p in _contexts(tokens, i)]
            seeds.append(own)
        yield pa.record_batch([batch.column(0), batch.column(1), _array(spans, SPAN), _array(seeds, _SEED)], names=["key", "hash", "spans", "seeds"])


def _array(rows: list, kind: T.StructType) -> pa.Array:
    to = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
    return pa.array(rows, pa.list_(pa.struct([(f.name, to[f.dataType]) for f in kind.fields])))


def filler(text: str, start: int) -> int:
    """Where the filler that begins at `start` ends: before white space, quotation marks and punctuation at its end.

    A filler with a digit, or of a few capitals, goes on over all groups that follow it, one space between them, if they have
    a digit or are a few capitals before a group that has one, however many they are.
    """
    found = _FILLER.match(text, start)
    if not found:
        return start
    end = found.end()
    if (_DIGIT.search(found[0]) or end - start <= 6 and found[0].isalpha() and found[0].isupper()) and (more := _GROUPS.match(text, end)):
        end = more.end()
    # a bracket at the end belongs to a filler that opens it
    loose = text.count(")", start, end) - text.count("(", start, end)
    while end > start and (text[end - 1] in ".!?:-" or text[end - 1] == ")" and loose > 0):
        loose -= text[end - 1] == ")"
        end -= 1
    return end


def shape(text: str) -> str:
    """Runs of digits as 9, of letters as a, A or Aa; other characters as they are."""
    for pattern, sign in _RUNS:
        text = pattern.sub(sign, text)
    return text


class _Last(dict):
    """Whether a token may be the last one of a pattern, by a bitmap of these; MEMORY tokens are remembered at most."""

    def __init__(self, bits: bytes):
        self._bits = bits

    def __missing__(self, token: str) -> bool:
        if len(self) >= MEMORY:
            self.clear()
        h = _hash(token) & BITS - 1
        found = self[token] = bool(self._bits[h >> 3] >> (h & 7) & 1)
        return found


def _hits(tokens: list[str], bits: bytes, last: _Last) -> Iterator[tuple[int, int]]:
    """Places (the number of the token that fills one) and the pattern before each, of the patterns that the bitmap has."""
    digest = xxhash.xxh64_intdigest
    mask = BITS - 1
    for i in [i for i, some in enumerate(map(last.__getitem__, tokens), 1) if some]:
        if i == len(tokens):
            return
        for k in (2, 3):
            if i >= k:
                h = digest("\x1f".join(tokens[i - k : i]))
                if bits[(h & mask) >> 3] >> (h & 7) & 1:
                    yield i, h


def _places(bits: bytes, ends: bytes):
    """How many places each pattern of the bitmap has, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _Last(ends)
        for batch in batches:
            totals: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                totals.update(h for _, h in _hits(_TOKEN.findall(text.lower()), bits, last))
            yield pa.record_batch([pa.array(map(_signed, totals), pa.int64()), pa.array(totals.values(), pa.int64())], names=["pattern", "n"])

    return run


def _second(bits: bytes, ends: bytes):
    """Fillers of the places after patterns of the bitmap, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _Last(ends)
        for batch in batches:
            rows: list[tuple] = []
            for key, hashed, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hits = list(_hits(_TOKEN.findall(text.lower()), bits, last))
                if not hits:
                    continue
                wanted = {i for i, _ in hits}
                taken = sorted((s[1], s[2]) for s in base_spans(text) + secret_spans(text))
                starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
                places: dict[int, tuple | None] = {}
                for i, m in enumerate(_TOKEN.finditer(text)):
                    if i in wanted:
                        places[i] = _place(text, m.start(), taken, starts, reach)
                for i, h in hits:
                    if places.get(i):
                        instance, form, start, end, seed = places[i]
                        rows.append((h, instance, form, None, None, None, None, True) if seed else (h, instance, form, key, hashed, start, end, False))
            if rows:
                pattern, instance, form, keys, hashes, start, end, seed = (list(x) for x in zip(*rows, strict=True))
                signed = [pa.array(map(_signed, column), pa.int64()) for column in (pattern, instance, form)]
                rest = [pa.array(hashes, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(seed, pa.bool_())]
                yield pa.record_batch([*signed, pa.array(keys, batch.column(0).type), *rest], names=["pattern", "instance", "shape", "key", "hash", "start", "end", "seed"])

    return run


def _place(text: str, start: int, taken: list[tuple[int, int]], starts: list[int], reach: list[int]) -> tuple | None:
    """What fills the place: hashes of it and of its shape, begin, end, whether it is a seed. None where it is empty or in a span.

    taken: the spans in order, with their starts and the farthest end up to each.
    """
    at = bisect_left(starts, start)
    if at < len(starts) and starts[at] == start:
        seed = text[start : taken[at][1]]
        return _hash(seed.lower()), _hash(shape(seed)), start, taken[at][1], True
    end = filler(text, start)
    if end == start or at and reach[at - 1] > start or at < len(starts) and starts[at] < end:
        return None
    found = text[start:end]
    return _hash(found.lower()), _hash(shape(found)), start, end, False


def _bitmap(patterns: DataFrame, column: str = "pattern") -> bytes:
    """The lowest bits of the patterns, or of their last tokens, as a bitmap of BITS bits: BITS / 32768 rows of 4 KB, whatever the data."""
    place = F.pmod(F.col(column), F.lit(BITS)) + 1
    rows = patterns.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def _logit(p: Column) -> Column:
    bound = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(bound / (1 - bound))


def confident(edges: DataFrame, totals: DataFrame, rounds: int = 3, smooth: float = 2.0, shape_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Confidence of the patterns (pattern, confidence) and scores of what isn't a seed (instance, shape, score) after `rounds`.

    edges: pattern, instance, shape, n, seed; totals: pattern, total (all its places). Seeds have score 1. A pattern's
    confidence is the mass of its fillers' scores in its places, a shape's the same in all fillers with it, both smoothed:
    by `smooth` places without an identifier for a pattern, with as many as fillers have on the whole for a shape. What a
    shape is worth beyond the whole moves the log odds of a filler by `shape_weight` of it.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for i in range(rounds):
        # a prior of 0 has no logit and no filler to score
        whole = scored.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("mass")).first()
        prior = (whole["mass"] or 0.0) / (whole["n"] or 1)
        mass = scored.groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("mass"))
        confidence = F.col("mass") / (F.greatest("total", "mass") + smooth)
        patterns = written(mass.join(totals, "pattern").select("pattern", confidence.alias("confidence")), f"pii-patterns-{i}")
        by_shape = scored.groupBy("shape").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("mass"))
        shapes = by_shape.select("shape", ((F.col("mass") + smooth * prior) / (F.col("n") + smooth)).alias("typical"))
        places = edges.where("not seed").join(patterns, "pattern").groupBy("instance", "shape")
        pure = places.agg((F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("pure")).join(shapes, "shape")
        odds = _logit(F.col("pure")) + shape_weight * (_logit(F.col("typical")) - _logit(F.lit(prior)))
        instances = written(pure.select("instance", "shape", (1 / (1 + F.exp(-odds))).alias("score")), f"pii-instances-{i}")
        scores = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        scored = edges.join(instances, ["instance", "shape"], "left").withColumn("score", scores)
    return patterns, instances


def extract(documents: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, confidence: float = 0.6, rounds: int = 3, shape_weight: float = 0.5, least_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, hash, spans) of every row's base and secret spans, and (key, hash, found) of those with more.

    hash is xxhash64 of the text, so that key and hash name a row's text.
    """
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(text)).alias("hash"), text_or_empty(text).alias("text"))
    first = T.StructType([T.StructField("key", kind), T.StructField("hash", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("seeds", T.ArrayType(_SEED))])
    base = written(rows.mapInArrow(_first, first), "pii-base")
    seeds = base.select(F.explode("seeds").alias("seed")).select("seed.*").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.first("last").alias("last"))
    able = written(seeds.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("held"), F.first("last").alias("last")).where(F.col("seeds") >= support), "pii-able")
    # the join ends false hits of the bitmap
    counted = rows.select("text").mapInArrow(_places(_bitmap(able), _bitmap(able, "last")), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    induced = written(counted.join(able, "pattern").where(F.col("held") >= least_share * F.col("total")).select("pattern", "total", "last"), "pii-induced")
    long = ("pattern", "instance", "shape")
    second = T.StructType([*[T.StructField(c, T.LongType()) for c in long], T.StructField("key", kind), T.StructField("hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("seed", T.BooleanType())])
    fillers = written(rows.mapInArrow(_second(_bitmap(induced), _bitmap(induced, "last")), second).join(induced, "pattern", "left_semi"), "pii-fillers")
    # an instance is a seed or not wherever it stands
    edges = written(fillers.groupBy("pattern", "instance", "shape", "seed").agg(F.count("*").alias("n")), "pii-edges")
    patterns, instances = confident(edges, induced, rounds, shape_weight=shape_weight)
    sure, likely = patterns.where(F.col("confidence") >= confidence), instances.where(F.col("score") >= confidence)
    spans = fillers.where("not seed").join(sure, "pattern", "left_semi").join(likely, ["instance", "shape"], "left_semi")
    found = spans.groupBy("key", "hash").agg(F.array_sort(F.collect_set(F.struct(F.lit("found").alias("kind"), "start", "end"))).alias("found"))
    return base.select("key", "hash", "spans"), written(found, "pii-found")


def personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per row of `documents`: key, spans (kind, start, end; base kinds in their order, then secret, then found)."""
    base, found = extract(documents, key, text, **options)
    found = found.select(F.col("key").alias(OWN + "key"), F.col("hash").alias(OWN + "hash"), "found")
    both = base.join(found, base["key"].eqNullSafe(found[OWN + "key"]) & (base["hash"] == found[OWN + "hash"]), "left")
    return both.select(F.col("key").alias(key), F.when(F.col("found").isNull(), F.col("spans")).otherwise(F.concat("spans", "found")).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span as its kind in square brackets; spans that overlap become one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


@pandas_udf(T.StringType())
def _masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, found in batches:
        out = []
        for text, more in zip(texts, found, strict=True):
            if text is None:
                out.append(None)
                continue
            spans = base_spans(text) + secret_spans(text) + [(s["kind"], s["start"], s["end"]) for s in (() if more is None else more)]
            out.append(mask(text, spans) if spans else text)
        yield pd.Series(out, dtype=object)


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`documents` with the text's spans masked; null texts stay null."""
    _, found = extract(documents, key, text, **options)
    found = found.select(F.col("key").alias(OWN + "key"), F.col("hash").alias(OWN + "hash"), F.col("found").alias(OWN + "found"))
    same = documents[key].eqNullSafe(found[OWN + "key"]) & (F.xxhash64(text_or_empty(documents[text])) == found[OWN + "hash"])
    return documents.join(found, same, "left").withColumn(text, _masked(F.col(text), F.col(OWN + "found"))).select(*documents.columns)
