"""Fill-in-the-middle: texts cut at two hashed ranks among their tokens, in constant memory beside the text itself.

A token is a run of white space with the run of other characters after it, or white space that ends the text. Two passes
of a lazy match iterator do the work: the first counts the tokens; a hash of seed and key gives two ranks up to that
number; the second advances to the smaller rank and on to the larger one and stops there. Only the current match exists
at any time, so no list of tokens or places is ever stored, however long the text is.

What comes out is the text with its middle at the end: psm is <P>prefix<S>suffix<M>middle, spm is
<S>suffix<P>prefix<M>middle, plain is the text as it was. `restored` rebuilds the text from output and form, in columns.

Defined results: null and empty texts are plain with no token; a text with one of the three marks is plain, so that marks
in an output are those that were put there; a null key hashes as empty; repeated rows give the same output.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import text_or_empty

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SPACE = r"\x20\x09-\x0D"
UNIT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
# the same matches; possessive, as a run that was taken is never given back
_UNIT = re.compile(rf"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")

SCHEMA = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
)


def draws(key: str | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def count(text: str) -> int:
    """The number of tokens: the first pass."""
    return sum(map(bool, _UNIT.finditer(text)))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first `low` and the first `high` tokens end: the second pass, which goes no further."""
    matches = _UNIT.finditer(text)
    last = deque(islice(matches, low), maxlen=1)
    first = last[0].end() if last else 0
    last = deque(islice(matches, high - low), maxlen=1)
    return first, last[0].end() if last else first


def transform(key: str | None, text: str | None, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text. `percent` of the texts are rearranged, `spm_percent` of these as spm."""
    text = text or ""
    n = count(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(key: str | Column, text: str | Column, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> Column:
    """A struct of n, form, prefix_chars, middle_chars (code points; null where plain) and output of each text."""

    @pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows = [transform(k, t, seed, percent, spm_percent) for k, t in zip(keys, texts, strict=True)]
            made = dict(zip(SCHEMA.names, zip(*rows, strict=True), strict=True)) if rows else {c: () for c in SCHEMA.names}
            numbers = {c: pd.array(made[c], "Int64") for c in ("n", "prefix_chars", "middle_chars")}
            yield pd.DataFrame({c: numbers.get(c, pd.Series(made[c], dtype=object)) for c in SCHEMA.names})

    of = lambda c: F.col(c) if isinstance(c, str) else c
    return run(of(key).cast("string"), text_or_empty(text))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = lambda i: F.element_at(F.split(output, "|".join(MARKS)), i)  # noqa: E731  the first part is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))
