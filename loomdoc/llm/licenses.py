"""Licence scan: notice phrases and identifier tags by Aho-Corasick, tag expressions by a shunting-yard parser.

Defined results: a null or empty text has no words, no label and score 0; repeated rows give repeated rows; nulls
and clashing names in other columns don't matter, as only the text is read and outputs carry the given prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import code_points

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases (words of a notice, label, weight of the evidence).
NOTICES = [
    ("mit license", "mit", 0.6),
    ("apache license", "apache", 0.6),
    ("general public license", "gpl", 0.6),
    ("apache license version 2 0", "apache-2.0", 0.8),
    ("gnu general public license version 2", "gpl-2.0", 0.8),
    ("gnu general public license version 3", "gpl-3.0", 0.8),
    ("lesser general public license", "lgpl", 0.7),
    ("affero general public license", "agpl", 0.7),
    ("mozilla public license", "mpl", 0.7),
    ("eclipse public license", "epl", 0.7),
    ("bsd license", "bsd", 0.6),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("permission is hereby granted free of charge", "mit", 0.8),
    ("isc license", "isc", 0.6),
    ("licensed under cc by 4 0", "cc-by-4.0", 0.8),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 0.8),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 0.8),
    ("creative commons attribution", "cc-by", 0.6),
    ("cc0 1 0 universal", "cc0-1.0", 0.8),
    ("released into the public domain", "public-domain", 0.7),
    ("all rights reserved", "all-rights-reserved", 0.4),
]
TAG, TAG_TEXT, TAG_WEIGHT = "spdx license identifier", "spdx-license-identifier:", 0.9
#: Licences that the default policy accepts, and exceptions that turn a licence into an accepted one.
ACCEPTED = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "0bsd")
EXCEPTIONS = ("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception")

PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("accepted", T.ArrayType(T.BooleanType())), T.StructField("places", T.ArrayType(PLACE))]
)

_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_SPACE = re.compile(r"\s*")
_PLAIN = re.compile(r"(?:\s|[()]|(?<![A-Za-z0-9.+:-])[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?(?![A-Za-z0-9.+:-]))*")  # nothing but tokens
_RANK = {"or": 1, "and": 2, "with": 3}
_KNOWN = frozenset([*ACCEPTED, *EXCEPTIONS, *(label for _, label, _ in NOTICES)])
_TAGS = re.compile(re.escape(TAG_TEXT) + r"[ \t]*", re.IGNORECASE)
_BREAK = re.compile(r"[\r\n]")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, weight in NOTICES:
        found.add_word(f" {phrase} ", (phrase, label, weight))
    found.add_word(f" {TAG} ", (TAG, None, TAG_WEIGHT))
    found.make_automaton()
    return found


def parse(expression: str) -> list[str] | None:
    """The licence expression in postfix order, or None where it is malformed. `with` binds before `and`, that before `or`."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether an operand has just ended
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if operand:
                return None
            waiting.append(word)
        elif word == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in _RANK:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        else:
            if operand:
                return None
            out.append(word)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def prefix(line: str) -> tuple[str, list[str] | None]:
    """The longest licence expression that the line begins with, and it in postfix order; the whole line and None without one.

    An expression ends where an operand follows an operand, at a character that expressions don't have, and at an operand
    with punctuation after it. Operators of running prose are lower case: with more text behind them, they only count
    before what looks like a licence name.
    """
    whole = parse(line)
    if whole is not None and _PLAIN.fullmatch(line):
        return line, whole
    best = at = depth = 0
    operand = prose = False  # whether an operand has just ended; whether an operator in lower case has
    while found := _TOKEN.match(line, _SPACE.match(line, at).end()):
        token, at = found[0], found.end()
        if token == "(":
            if operand:
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif token.lower() in _RANK:
            if not operand:
                break
            operand, prose = False, token.islower()
            continue
        else:
            name = token.rstrip(".:-")
            if operand or not name or not name[0].isalnum() or prose and not _named(name):
                break
            operand, prose = True, False
            if name != token:
                best = found.start() + len(name) if not depth else best
                break
        if operand and not depth:
            best = at
    return (line[:best], parse(line[:best])) if best else (line, None)


def _named(word: str) -> bool:
    """Whether a word in running prose looks like a licence or an exception."""
    return word.lower() in _KNOWN or any(c.isdigit() or c == "-" for c in word)


def evaluate(postfix: list[str], accepted: Iterable[str] = ACCEPTED, exceptions: Iterable[str] = EXCEPTIONS) -> bool:
    """Whether the policy accepts the expression: `or` needs one side, `and` both, `with` the licence or a known exception."""
    accepted, exceptions = set(accepted), set(exceptions)
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token in _RANK:
            (right, name), (left, licence) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left or name in exceptions, licence))
            else:
                stack.append((left or right if token == "or" else left and right, ""))
        else:
            stack.append((token in accepted, token))
    return stack[0][0]


def licences_of(postfix: list[str]) -> set[str]:
    """The licence names of an expression, without its exceptions."""
    names: list[set[str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = names.pop(), names.pop()
            names.append(left if token == "with" else left | right)
        else:
            names.append({token})
    return names[0]


def scan(text: str | None) -> dict:
    """What RESULT names, for one text."""
    words = code_points((text or "").encode("utf-8", "surrogatepass")).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places: list[tuple[str, int, int]] = []
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    evidence: dict[str, float] = {}
    expressions: list[str] = []
    accepted: list[bool | None] = []
    at, seen = 0, 0  # words counted up to the character `at`
    tagged = False
    for end, (phrase, label, weight) in sorted(_automaton().iter(line), key=lambda x: x[0] - len(x[1][0])):
        start = end - len(phrase) - 1
        seen, at = seen + line.count(" ", at, start), max(at, start)
        if label is None:
            tagged = True
            continue
        places.append((label, seen, seen + phrase.count(" ")))
        labels.add(label)
        evidence[phrase] = weight
        if phrase in BASE:
            base.append(seen)
            base_labels.add(BASE[phrase])
    if tagged:
        tags = list(_TAGS.finditer(text))
        for tag, following in zip(tags, [*tags[1:], None], strict=True):
            # a tag ends at its line's end, or where the next one begins
            stop = following.start() if following else len(text)
            broken = _BREAK.search(text, tag.end(), stop)
            line_, postfix = prefix(text[tag.end() : broken.start() if broken else stop])
            expressions.append(line_)
            accepted.append(None if postfix is None else evaluate(postfix))
            if postfix is not None:
                labels |= licences_of(postfix)
                evidence[TAG] = TAG_WEIGHT
    doubt = 1.0
    for phrase in [x[0] for x in NOTICES] + [TAG]:
        doubt *= 1 - evidence.get(phrase, 0.0)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": round(1 - doubt, 6),
        "expressions": expressions, "accepted": accepted, "places": [dict(zip(("label", "first", "last"), p, strict=True)) for p in places],
    }


@pandas_udf(RESULT)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = pd.DataFrame([scan(x) for x in texts], columns=RESULT.names)
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def licence_scan(text: str | Column) -> Column:
    """A struct of RESULT for each text: labels, places, parsed expressions and the confidence score."""
    return _scan(F.col(text) if isinstance(text, str) else text)
