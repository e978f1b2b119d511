"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens: words score positive, tags negative, and what stands in elements that are never content
(menus, forms, adverts, comments ...) counts as tags do. Such elements are told by their kind, or by a class, id or role all of
whose pieces say so; a name that only has such a piece is a feature, whose weight is learned. Whatever an element is named,
the one with the page's principal content is content, and so are those around it. The weights are learned from labelled pages: pages which mark
their content by an `article` or `main` element are the labels, a bounded sample of the distinct ones (`max_pages`, the
smallest hashes) is read, and a structured perceptron moves the weights until the best-scoring region is the marked one.
The mark is the label and no feature: no weight is learned for it, and it scores as an unknown tag. The linear scan for
the best contiguous region then serves all pages, marked or not.

Defined results: null, empty and contentless pages have the empty text; unclosed tags, comments and references are read
as browsers do; equal scores prefer the earliest and longest region; repeated rows and null keys are kept; only the
html column is read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Elements of the HTML standard by their role.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del wbr big".split())
NEVER = frozenset("head nav header footer aside form button select svg canvas object video audio dialog menu script style noscript template textarea title iframe".split())
#: Names of class, id and role, or pieces of them, that name what is never content.
AROUND = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices
 alert popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar aside widget comment
 comments reply replies disqus share sharing social related recommended pagination pager search login contentinfo complementary""".split())
#: Pieces that say nothing by themselves, so that site-header is a header and with-sidebar no sidebar.
NEUTRAL = frozenset("site page global primary secondary top bottom left right inner outer main list box bar block area wrap wrapper container section panel unit slot link links item items widget button buttons icon icons form the".split())
#: Names of what readers write, and of what a paragraph or heading has to be named to be none of the text.
READERS = frozenset("comment comments reply replies disqus".split())
PAID = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figure figcaption".split())
CONTENT = frozenset(("article", "main"))

_OPEN = re.compile(r"<(?:[!?]|/?[A-Za-z])")
# a tag whose quoted values may have angle brackets, and one that ends at the next bracket
_QUOTED = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PIECES = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"\S+")


@dataclass(slots=True)
class Token:
    kind: str  # the feature: "word", "/name", "name", "around", or "mark" (content elements: never learned)
    text: str | None  # of a run of words; None for tags
    block: bool  # whether it ends a block
    words: int  # how many tokens it stands for
    around: bool  # in an element that is never content
    mark: str = ""  # the name of a content element, with a slash where it ends


def _named(attributes: str) -> Iterator[list[str]]:
    """The pieces of every name in class, id and role."""
    for value in _NAMED.findall(attributes) if "=" in attributes else ():
        for name in value.strip("\"'").split():
            yield _PIECES.findall(_HUMPS.sub("-", name).lower())


def _aside(name: str, attributes: str) -> bool:
    """Whether an element is never content: by what it is, or by a name of which every piece says so or nothing."""
    if name in NEVER:
        return True
    if name in ("html", "body"):
        return False
    words = PAID if name in TEXTUAL else AROUND
    return any(not words.isdisjoint(p) and words.union(NEUTRAL).issuperset(p) for p in _named(attributes))


def _readers(name: str, attributes: str) -> bool:
    return any(not READERS.isdisjoint(p) and READERS.union(NEUTRAL).issuperset(p) for p in _named(attributes))


Tag = tuple[int, int, str, bool, str]


def _parsed(page: str) -> list[Tag]:
    """The page's tags; one whose content is no markup ends where that does."""
    out = []
    reader = tags(page)
    tag = next(reader, None)
    while tag:
        start, end, name, close, attributes = tag
        if name in RAW and not close:
            closing = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, end)
            end = closing.end() if closing else len(page)
        out.append((start, end, name, close, attributes))
        try:
            tag = reader.send(end)
        except StopIteration:
            tag = None
    return out


def _trusted(page: str, parsed: list[Tag]) -> frozenset[int]:
    """Where the elements begin that are content whatever they are named: those around the page's principal content.

    That is the content element with the most words, readers' comments aside, if it has a third of the page's words; and a
    form with more than half of them is the page's frame.
    """
    if not any(name in CONTENT or name == "form" for _, _, name, _, _ in parsed):
        return frozenset()
    words = at = most = 0
    open_: list[tuple[int, str, int, bool]] = []  # begin, name, words before, whether readers write there
    named: Counter[str] = Counter()
    best: list[int] = []
    forms: list[tuple[int, int]] = []

    def closed() -> str:
        nonlocal most, best
        start, name, before, readers = open_.pop()
        named[name] -= 1
        if name in CONTENT and not readers and words - before > most:
            most, best = words - before, [start, *[s for s, *_ in open_]]
        if name == "form":
            forms.append((start, words - before))
        return name

    for start, end, name, close, attributes in parsed:
        words += len(page[at:start].split())
        at = end
        if close and named[name]:
            while closed() != name:
                pass
        elif name and not close and name not in VOID and name not in RAW and name not in INLINE and not attributes.endswith("/"):
            open_.append((start, name, words, bool(open_ and open_[-1][3]) or _readers(name, attributes)))
            named[name] += 1
    words += len(page[at:].split())
    while open_:
        closed()
    return frozenset([*(best if 3 * most >= words else ()), *(s for s, n in forms if 2 * n > words)])


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name (lower case; empty for comments and declarations), whether it closes, and attributes of each tag.

    A reader may send the place to go on from. Each character is looked at a bounded number of times: once a quoted value
    has no end, tags end at the next bracket up to the page's end, and behind the last bracket there is no tag.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while found := _OPEN.search(page, at):
        start = found.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            tag = (start, end + 3 if end >= 0 else len(page), "", False, "")
        elif start > last:
            return
        elif page[start + 1] in "!?":
            tag = (start, page.index(">", start) + 1, "", False, "")
        else:
            whole = _QUOTED.match(page, start) if quoted else None
            quoted = bool(whole)
            whole = whole or _PLAIN.match(page, start)
            tag = (start, whole.end(), whole[2].lower(), bool(whole[1]), whole[3])
        at = (yield tag) or tag[1]


def _feature(name: str, attributes: str) -> str:
    """The tag, with the pieces of its names that are words of AROUND: each such pair has a weight of its own."""
    found = sorted({x for p in _named(attributes) for x in p if x in AROUND})
    return f"{name}.{found[0]}" if found else name


def tokens(page: str) -> list[Token]:
    """Runs of words and tags in page order. Marks of the content are tokens of the kind `mark`, which no weight is learned for."""
    out: list[Token] = []
    at, n = 0, len(page)
    around: list[str] = []  # open elements from the outermost one that is never content
    opened: Counter[str] = Counter()  # the same by name

    def words(start: int, end: int) -> None:
        if start < end:
            text = html.unescape(page[start:end])
            count = len(text.split())
            out.append(Token("around" if around else "word", text, False, count, bool(around)))

    parsed = _parsed(page)
    trusted = _trusted(page, parsed)
    for start, end, name, close, attributes in parsed:
        words(at, start)
        at = end
        block = name not in INLINE
        mark = "" if around or name not in CONTENT else "/" + name if close else name
        if not name:
            pass
        elif close:
            if opened[name]:
                while (inner := around.pop()) != name:
                    opened[inner] -= 1
                opened[name] -= 1
                out.append(Token("/" + name if not around else "around", None, block, 1, True))
            else:
                out.append(Token("around" if around else "mark" if mark else "/" + name, None, block, 1, bool(around), mark))
        else:
            aside = bool(around) or start not in trusted and _aside(name, attributes)
            out.append(Token("around" if aside else "mark" if mark else _feature(name, attributes), None, block or name == "br", 1, aside, "" if aside else mark))
            if aside and name not in RAW and name not in VOID and not attributes.endswith("/"):
                around.append(name)
                opened[name] += 1
    words(at, n)
    return out


def _marked(sequence: list[Token]) -> tuple[int, int] | None:
    """The range within the first content element, or None where a page has none."""
    start = name = None
    for i, t in enumerate(sequence):
        if start is None and t.mark in CONTENT:
            start, name, depth = i + 1, t.mark, 1
        elif start is not None and t.mark in (name, "/" + name):
            depth += 1 if t.mark == name else -1
            if not depth:
                return start, i
    return None if start is None else (start, len(sequence))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous range with the largest sum; one pass. Empty where no score is positive."""
    best, at, begin, total = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best or (total == best and total > 0 and at[0] == begin):
            best, at = total, (begin, i + 1)
    return at


def _scores(sequence: list[Token], weights: dict[str, float], other: float) -> list[float]:
    return [weights["word"] * t.words if t.kind == "word" else weights.get(t.kind, other) * max(1, t.words) for t in sequence]


def start_weights() -> dict[str, float]:
    return {"word": 1.0, "around": -1.0}


def learn(pages: list[str], rounds: int = 6, least: float = 0.001, unknown: float = -0.02) -> dict[str, float]:
    """Averaged structured perceptron: words stay positive, tags stay negative."""
    weights, total, n = start_weights(), Counter(), 0
    examples = [(s, m) for s in map(tokens, pages) if (m := _marked(s))]
    for _ in range(rounds):
        missed = 0
        for sequence, (a, b) in examples:
            p, q = best_region(_scores(sequence, weights, unknown))
            # the marked range without what scores nothing at its ends
            gold = _trim(sequence, a, b)
            if _trim(sequence, p, q) != gold:
                missed += 1
                for sign, (x, y) in ((0.1, gold), (-0.1, (p, q))):
                    for t in (t for t in sequence[x:y] if t.kind != "mark"):
                        weights[t.kind] = weights.get(t.kind, unknown) + sign * max(1, t.words) / len(sequence)
                for k in weights:
                    weights[k] = max(least, weights[k]) if k == "word" else min(-least, weights[k])
            total.update(weights)
            n += 1
        if not missed:
            break
    return {k: v / n for k, v in total.items()} if n else weights


def _trim(sequence: list[Token], a: int, b: int) -> tuple[int, int]:
    useful = [i for i in range(a, b) if sequence[i].kind == "word" and sequence[i].words]
    return (useful[0], useful[-1] + 1) if useful else (a, a)


def main_text(page: str | None, weights: dict[str, float], unknown: float = -0.02) -> str:
    """The page's main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    sequence = tokens(page)
    a, b = best_region(_scores(sequence, weights, unknown))
    blocks: list[list[str]] = [[]]
    for t in sequence[a:b]:
        if t.around:
            if t.block:
                blocks.append([])
        elif t.text is not None:
            blocks[-1].append(t.text)
        elif t.block and t.kind != "br":
            blocks.append([])
        elif t.kind == "br":
            blocks[-1].append(" ")
    joined = (" ".join("".join(x).split()) for x in blocks)
    return "\n\n".join(x for x in joined if x)


def train(pages: DataFrame, column: str = "html", max_pages: int = 400, max_bytes: int = 1 << 26) -> dict[str, float]:
    """Weights from a bounded sample of the pages that mark their content; where none does, the starting weights.

    Copies of a page count once. Of the `max_pages` smallest hashes, what fits into `max_bytes` of outlines reaches the driver.
    """
    marked = pages.select(F.col(column).alias("page")).where(F.lower("page").rlike("<(article|main)[\\s>]")).withColumn("hash", F.xxhash64("page"))
    counted = marked.groupBy("hash").agg(F.count("*"))
    share = min(1.0, 4 * max_pages / max(1, counted.count()))
    # about four times as many as needed by a threshold, so that only those are sorted
    low = marked.where(F.pmod("hash", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    sample = low.groupBy("hash").agg(F.first("page").alias("page")).orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(max_pages)
    # tags and counts are all that learning needs, so that long pages reach the driver as short ones
    outlines = sample.select("page", "hash").mapInArrow(_outline, "page string, hash long")
    fits = outlines.withColumn("bytes", F.sum(F.octet_length("page")).over(Window.orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)))
    rows = fits.where(F.col("bytes") <= max_bytes).collect()  # over max_pages rows
    return learn(sorted(r["page"] for r in rows))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with every word as the letter w, to learn from."""
    for batch in batches:
        out = []
        for page in batch.column(0).to_pylist():
            parts, at = [], 0
            for start, end, *_ in tags(page):
                parts += [" w" * len(_WORD.findall(page[at:start])), page[start:end]]
                at = end
            out.append("".join([*parts, " w" * len(_WORD.findall(page[at:]))]))
        yield pa.record_batch([pa.array(out, pa.string()), batch.column(1)], names=["page", "hash"])


def extractor(weights: dict[str, float]):
    """A column function: html to main text."""

    @pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, weights) for x in pages], dtype=object)

    return extract


def extract_main(pages: DataFrame, column: str = "html", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """`pages` with the main text in a column."""
    return pages.withColumn(text, extractor(weights or train(pages, column))(F.col(column)))
