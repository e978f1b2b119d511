"""Text to chunks: paragraphs, list items, sentences, words, packed with overlap. All of it column expressions.

Every step is linear in the text: protected blocks are found by patterns, pieces carry their number of words, and the one
fold over the pieces of a text keeps a chunk of bounded size, to whose list it only adds where a chunk ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions import text as t


@dataclass(frozen=True)
class ChunkConfig:
    """Limits in estimated tokens; columns where rows of several configurations go one way, and those aren't checked."""

    chunk_size: int | Column = 400
    overlap: int | Column = 50
    image_chunk_size: int = 300
    image_overlap: int = 30

    def __post_init__(self) -> None:
        for size, overlap in ((self.chunk_size, self.overlap), (self.image_chunk_size, self.image_overlap)):
            if isinstance(size, Column) or isinstance(overlap, Column):
                continue
            if size <= 0:
                raise ValueError("chunk sizes must be positive")
            if not 0 <= overlap < size:
                raise ValueError("overlaps must be 0 or more and less than their chunk size")


#: Sizes of files without a chunker of their own.
FALLBACK = ChunkConfig(500, 100)

_FENCE = r"```[^\n]*\n(?s:.*?)```"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
_ROW = rf"{_BLANK}*+\|(?:[^\n]*\|)?{_BLANK}*+(?![^\n])"
_TABLE = rf"(?<![^\n]){_ROW}(?:\n{_ROW})*+"
_PLACE = r"\x00BLOCK(\d+)\x00"


def _placeholder(i: Column) -> Column:
    return F.concat(F.lit("\x00BLOCK"), i.cast("string"), F.lit("\x00"))


def _joined(pieces: Column, between) -> Column:
    """The pieces in a row, with `between(i)` before piece i + 1."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(between(i - 1), p))), "")


def masked(text: Column) -> Column:
    """Struct (text, blocks): fenced code, then runs of table lines, each as a placeholder of one word."""

    def without(found: Column, pattern: str, first: Column) -> Column:
        return _joined(F.split(found, pattern), lambda i: _placeholder(first + i))

    def hidden(codes: Column) -> Column:
        plain = without(text, _FENCE, F.lit(0))
        return t.let(
            plain,
            lambda x: F.struct(
                without(x, _TABLE, F.size(codes)).alias("text"),
                F.concat(codes, F.regexp_extract_all(x, F.lit(_TABLE), F.lit(0))).alias("blocks"),
            ),
        )

    whole = F.struct(text.alias("text"), F.array().cast("array<string>").alias("blocks"))
    some = t.let(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0)), hidden)
    return F.when(F.contains(text, F.lit("|")) | F.contains(text, F.lit("```")), some).otherwise(whole)


def restored(text: Column, blocks: Column) -> Column:
    """Placeholders as their blocks; what a block has isn't looked at again."""
    numbers = F.regexp_extract_all(text, F.lit(_PLACE), F.lit(1))
    block = lambda n: lambda i: F.coalesce(F.get(blocks, F.get(n, i).cast("int")), F.lit(""))
    return F.when(F.contains(text, F.lit("\x00BLOCK")), t.let(numbers, lambda n: _joined(F.split(text, _PLACE), block(n)))).otherwise(text)


def split_large(unit: Column, size: Column, overlap: Column) -> Column:
    """Pieces of at most `size` tokens: parts that are too large go on to the next splitter, and to word windows at last.

    A splitter that finds one part hands it on unchanged, so that the chain is written once.
    """

    def within(parts: Column, deeper) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(t.token_count(p) <= size, F.array(t.strip(p))).otherwise(deeper(p))))

    def by_sentences(x: Column) -> Column:
        return within(t.sentences(x), lambda s: t.word_windows(s, size, overlap))

    def by_items(x: Column) -> Column:
        return within(t.list_items(x), by_sentences)

    return within(F.array(unit), lambda x: within(t.paragraphs(x), by_items))


def most_shared(overlap: Column) -> Column:
    """Words that an overlap keeps at most."""
    return F.greatest(F.lit(1), (overlap / F.lit(t.TOKENS_PER_WORD)).cast("int"))


def tail(text: Column, overlap: Column) -> Column:
    """The last int(overlap / 1.3) words, at least one; a shorter text as it is; nothing for no overlap."""
    most = most_shared(overlap)
    cut = t.let(t.words(text), lambda w: F.when(F.size(w) <= most, text).otherwise(F.array_join(F.slice(w, -most, most), " ")))
    return F.when(overlap <= 0, "").otherwise(cut)


def packed(pieces: Column, size: Column, overlap: Column) -> Column:
    """Pieces (text, run, words) packed greedily, parted by an empty line; a full chunk hands its tail to the next.

    A chunk has pieces of one run, and nothing is handed on to another run.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("chunks"), F.lit("").alias("text"), F.lit(0).alias("words"), F.lit(-2).alias("run"))

    def step(s: Column, x: Column) -> Column:
        same = s["run"] == x["run"]
        ends = (s["text"] != "") & (~same | (t.tokens_of(s["words"] + x["words"]) > size))
        kept = F.when(same, tail(s["text"], overlap)).otherwise("")
        shared = F.when(same & (overlap > 0), F.least(s["words"], most_shared(overlap))).otherwise(0)
        glue = lambda a: F.when(a != "", F.concat(a, F.lit("\n\n"), x["text"])).otherwise(x["text"])
        begun = F.struct(
            F.concat(s["chunks"], F.array(s["text"])).alias("chunks"),
            t.let(kept, glue).alias("text"),
            (shared + x["words"]).alias("words"),
            x["run"].alias("run"),
        )
        grown = F.struct(s["chunks"].alias("chunks"), glue(s["text"]).alias("text"), (s["words"] + x["words"]).alias("words"), x["run"].alias("run"))
        return F.when(x["text"] == "", s).when(ends, begun).otherwise(grown)

    last = lambda s: F.when(s["text"] != "", F.concat(s["chunks"], F.array(s["text"]))).otherwise(s["chunks"])
    return F.aggregate(pieces, start, step, last)


def _piece(text: Column, run: Column) -> Column:
    return F.struct(text.alias("text"), run.cast("int").alias("run"), t.word_count(text).alias("words"))


def merged(units: Column, size: Column, overlap: Column) -> Column:
    """Units that all fit by themselves, packed as one run."""
    return packed(F.transform(units, lambda u: _piece(t.strip(u), F.lit(-1))), size, overlap)


def recursive_split(text: Column, size: Column | int = 500, overlap: Column | int = 100) -> Column:
    """Chunks of a text; code and tables stay whole and count as one word. An oversized unit is packed apart from its neighbours."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))

    def pieces(units: Column) -> Column:
        """Units that fit are of run -1, the pieces of another one of a run of their own."""
        large = lambda u, i: F.transform(split_large(u, size, overlap), lambda p: _piece(p, i))
        one = lambda u, i: t.let(_piece(u, F.lit(-1)), lambda p: F.when(t.tokens_of(p["words"]) > size, large(u, i)).otherwise(F.array(p)))
        return F.flatten(F.transform(units, one))

    def chunks(m: Column) -> Column:
        parts = F.filter(packed(pieces(t.paragraphs(m["text"])), size, overlap), lambda c: t.strip(c) != "")
        found = F.when(t.token_count(m["text"]) <= size, F.array(m["text"])).otherwise(parts)
        return F.transform(found, lambda c: restored(c, m["blocks"]))

    return t.let(t.strip(text), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(t.let(masked(x), chunks)))
