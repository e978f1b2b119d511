"""Text as columns: white space, words, tokens, lines, names, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java class of what Python strips and splits at.
BLANKS = r"\s\x1c-\x1f\x85\p{Z}"
SPACE = rf"[{BLANKS}]"
WORD = r"[^\s\x1c-\x1f\x85\p{Z}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TOKENS_PER_WORD = 1.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return strip_of(text, BLANKS)


def strip_of(text: Column, blanks: str) -> Column:
    """Text without the characters of a class at its ends; the dot runs to the end and back to the last other character, which no character's class is asked for on the way."""
    return F.regexp_extract(text, rf"(?s)\A[{blanks}]*+(.*[^{blanks}])?", 1)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens_of(n_words: Column) -> Column:
    """Estimated tokens of a number of words: 0 for none, else at least 1."""
    return F.when(n_words == 0, 0).otherwise(F.greatest(F.lit(1), (n_words * F.lit(TOKENS_PER_WORD)).cast("int")))


def token_count(text: Column) -> Column:
    return tokens_of(word_count(text))


def lines(text: Column, end: str = LINE_END) -> Column:
    """Lines at any line end; a last empty one doesn't count."""
    return let(F.split(text, end), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def is_table_line(line: Column) -> Column:
    return let(strip(line), lambda x: x.startswith("|") & x.endswith("|"))


def _foldings() -> dict[str, str]:
    """What full case folding makes of the characters that lower case leaves otherwise."""
    return {c: c.casefold() for c in map(chr, range(0x80, 0x1E944)) if not "\ud800" <= c <= "\udfff" and c.lower().casefold() != c.lower() and c == c.lower()}


def _class(chars: str) -> str:
    """A class of the characters in as few ranges as there are: every range is tried on every character."""
    points = sorted(map(ord, chars))
    begins = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(begins, ends)) + "]"


_FOLDINGS = _foldings()
_ONE = {c: f for c, f in _FOLDINGS.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDINGS.items() if len(f) > 1}
#: Any character out of Latin letters and punctuation, of which sharp s is the only one that lower case leaves to be folded.
_FOREIGN = r"[^\x00-\xb4\xb6-\u0148\u014a-\u017e\u2000-\u20ff\u1ea0-\u1eff\u0180-\u01ef\u0300-\u0344]"


def casefold(text: Column) -> Column:
    """Lower case with full case folding: sharp s as ss, final sigma as sigma, ligatures as letters."""
    rare = {c: f for c, f in _MORE.items() if c != "ß"}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in rare.items()])
    unfolded = lambda x: F.aggregate(pairs, x, lambda y, p: F.replace(y, p["c"], p["f"]))
    single = lambda x: F.translate(x, "".join(_ONE), "".join(_ONE.values()))
    whole = lambda x: let(single(x), lambda y: F.when(y.rlike(_class("".join(rare))), unfolded(y)).otherwise(y))
    sharp = lambda x: F.replace(x, F.lit("ß"), F.lit("ss"))
    ascii_only = lambda x: F.octet_length(x) == F.char_length(x)
    # one range is tried fastest; micro is the only other one of it that folds
    latin = lambda x: x.rlike(r"\A[\x00-\xff]*+\z") & ~F.contains(x, F.lit("µ"))
    return let(F.lower(text), lambda x: F.when(ascii_only(x), x).when(latin(x) | ~x.rlike(_FOREIGN), sharp(x)).otherwise(sharp(whole(x))))


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), strip), lambda x: x != "")


def sentences(text: Column, blanks: str = BLANKS) -> Column:
    """Sentences without white space at their ends, which the characters of the class `blanks` are."""
    bare = lambda x: strip_of(x, blanks)
    parts = F.filter(F.transform(F.split(bare(text), rf"(?<=[.!?])[{blanks}]+(?=[^{blanks}])"), bare), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) == 0, F.array(bare(text))).otherwise(p))


def list_items(text: Column, end: str = LINE_END, bare: Callable[[Column], Column] = strip) -> Column:
    """Items of a bullet list with their continuation lines; text before the first bullet makes it paragraphs, one item the text.

    `end` is where lines end, and `bare` is what an item is without what stands around it.
    """
    blank = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
    bullet = rf"{blank}*(?:[-*+]|\d+\.){blank}+"
    parts = F.split(F.array_join(lines(text, end), "\n"), rf"\n(?={bullet})")

    def items(p: Column) -> Column:
        # what stands before the first bullet is blank, or the text is prose
        found = F.filter(p, lambda x, i: (i > 0) | x.rlike(f"^{bullet}"))
        prose = ~p[0].rlike(f"^{bullet}") & (strip(p[0]) != "")
        return F.when(prose, paragraphs(text)).when(F.size(found) > 1, F.transform(found, bare)).otherwise(F.array(bare(text)))

    return let(parts, items)


def word_windows(text: Column, size: Column | int, overlap: Column | int) -> Column:
    """Windows of int(size / 1.3) words that share int(overlap / 1.3); the last one ends with the text."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    most = F.greatest(F.lit(1), (size / F.lit(TOKENS_PER_WORD)).cast("int"))
    step = F.greatest(F.lit(1), most - F.greatest(F.lit(0), (overlap / F.lit(TOKENS_PER_WORD)).cast("int")))

    def cut(w: Column) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.size(w) - most) / step)).cast("int")
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(w, i * step + 1, most), " ")))

    return let(words(text), cut)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def json_string(text: Column) -> Column:
    """A JSON string, non-ASCII kept."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)


def half_points(x: Column) -> Column:
    return F.bround(x * 2) / 2


def keyword_distance(matched: Column, total: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), 1 - matched / total), 3)


def like_ascii_ci(text: Column, term: str) -> Column:
    """`term` anywhere, case-insensitive for ASCII; % and _ in the term stay wildcards, a backslash is itself."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = term.strip().translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(text, upper, lower).like(f"%{pattern}%")


def without_comments(markdown: Column) -> Column:
    """Markdown without the page and OCR comments that converters leave."""
    return F.regexp_replace(markdown, r"(?i)<!--\s*(?:ocr-meta:|page:)[^>]*-->[ \t]*\r?\n?", "")


def iso_timestamp(text: Column) -> Column:
    """An ISO time; one without a zone is of zone Z; what is none is null."""
    bare = strip(text)
    return F.try_to_timestamp(F.when(bare.rlike(r"(Z|[+-]\d\d:?\d\d)$"), bare).otherwise(F.concat(bare, F.lit("Z"))))
