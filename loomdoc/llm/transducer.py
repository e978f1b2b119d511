"""BPE as a streaming transducer with bounded lookahead, and its decoder as a state machine from bytes to text.

A text goes through in pieces: canonical composition holds characters back to the last one that cannot join what stands
before it; a machine over character classes tells the words; and the symbols of an open word are merged again and again
in a window, from which a token leaves once nothing that may follow can change it. Memory depends on the vocabulary alone.

How far a change reaches is computed from the merge list (`lookahead`). Take two symbol sequences that agree up to place
p, and apply the merges in the order of their ranks. As long as the tokens up to a place D agree, applying the rule (u, v)
can only alter the last of them, where it is u and only one of both has v at D: D falls by the length of u. The tokens at
the new D both grew out of that u from its left edge. So a later rule (u', v') goes on only if u is on the left edge of
v', and the reach is the longest chain of rules of rising ranks, each with the left part of the one before on the left edge of its right part,
measured in left parts. Tokens that end that far before the first unknown symbol are final, and behind a final boundary
the merges start anew. The last symbol of a word has a mark of its own, so the newest symbol counts as unknown.

A process remembers the ids of short runs between white space and of short words; both memories are bounded. The library
is asked what it is not the point to do again: the composition and lower case of a piece, and the class of a character.

Defined results: null and empty texts have no ids; ids that the vocabulary doesn't have are dropped in decoding; bytes
that aren't UTF-8 decode to the replacement character; repeated rows give the same ids. Control strings in a text are
their own ids, as the library has it. A run of combining marks is held as a whole, as its order is only known at its end.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import text_or_empty
from loomdoc.llm.tokens import _byte_letters, _kind

WINDOW = 1 << 15  # characters that are split at a time
STEP = 256  # symbols that come into a window before it is merged again
SHORT, MEMORY = 64, 200_000  # characters of runs and words that are remembered, and how many
FEW = 24  # symbols up to which the least pair is looked for anew each time
ROWS = 512  # texts whose new words are merged together
WORDS = 4096  # new words that are merged together at most
IDS = 1 << 14  # ids that are decoded at a time
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: The endings after an apostrophe that are words.
ENDINGS = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")

_ASCII = re.compile("|".join([*ENDINGS, "[a-z]+", "[0-9]", "[^a-z0-9]+"]))
_KINDS = re.compile("l+|n|o+")

Merge = tuple[str, str]


def lookahead(merges: list[Merge]) -> int:
    """How many symbols before an unknown one a token has to end, so that nothing that follows can change it.

    The merges must build every token once, of symbols and earlier tokens; a ValueError tells where they don't.
    """
    left: dict[str, str] = {}
    size: dict[str, int] = {}
    reach: dict[str, int] = {}  # of the chains so far whose last rule has this left part
    later = {a + b for a, b in merges}
    most = 0
    for a, b in merges:
        if a + b in left or any(x in later and x not in left for x in (a, b)):
            raise ValueError(f"merge {a!r} {b!r} doesn't build a new token of earlier ones")
        far, edge = 0, b
        while edge:
            far, edge = max(far, reach.get(edge, 0)), left.get(edge, "")
        reach[a] = max(reach.get(a, 0), size.get(a, 1) + far)
        most = max(most, reach[a])
        left[a + b], size[a + b] = a, size.get(a, 1) + size.get(b, 1)
    return most


def merged(symbols: list[str], ranks: dict[Merge, int]) -> list[str]:
    """The tokens of a run of symbols: of all pairs the one with the least rank is merged first, the leftmost of equal ones."""
    parts: list[str | None] = list(symbols)
    n = len(parts)
    if n <= FEW:
        get, none = ranks.get, len(ranks)
        found = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found and (least := min(found)) < none:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), none)
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (found := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (found, a))
    return [p for p in parts if p is not None]


@cache
def _joins() -> frozenset[str]:
    """Characters that composition can join to one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    hangul = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, hangul))


def _begins(c: str) -> bool:
    """Whether composition never reaches from this character to what stands before it."""
    first = unicodedata.normalize("NFD", c)[0]
    return c < "̀" or not unicodedata.combining(first) and first not in _joins()


class _Memory(dict):
    """Ids by run or word, found when first asked for; short ones only.

    When MEMORY of them are held, they become the elder ones, which stay as long as they are asked for.
    """

    def __init__(self, find):
        self._find = find
        self._elder: dict[str, bytes] = {}

    def __missing__(self, name: str) -> bytes:
        found = self._elder.get(name)
        if found is None:
            found = self._find(name)
        self.keep(name, found)
        return found

    def has(self, name: str) -> bool:
        return name in self or name in self._elder

    def keep(self, name: str, ids: bytes) -> None:
        if len(name) <= SHORT:
            if len(self) >= MEMORY:
                self._elder = dict(self)
                self.clear()
            self[name] = ids


class _Kinds(dict):
    """Class signs by code point: l for letters, n for numbers, s for white space, o for others."""

    def __init__(self, kind_of):
        self._kind_of = kind_of

    def __missing__(self, code: int) -> str:
        found = self[code] = self._kind_of(chr(code))[0]
        return found


class _Together:
    """The merges as arrays, to merge many short words at a time."""

    def __init__(self, merges: list[Merge], ids: dict[str, int], letters: list[str], suffix: str):
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in range(2))
        keys = left << 32 | right
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order
        self._merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self._inner, self._last = (np.array([ids[c + end] for c in letters], np.int64) for end in ("", suffix))
        self._none = len(merges)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (right >= 0), self._ranks[at], self._none)

    def __call__(self, words: list[str]) -> list[bytes]:
        """Ids of each word: in every round, each word's least pair is merged, the leftmost of equal ones."""
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data])
        rows = np.full((len(data), int(sizes.max()) + 1), -1, np.int64)
        filled = np.arange(rows.shape[1]) < sizes[:, None]
        raw = np.frombuffer(b"".join(data), np.uint8)
        rows[filled] = self._inner[raw]
        rows[np.arange(len(data)), sizes - 1] = self._last[raw[np.cumsum(sizes) - 1]]
        ranks = self._rank(rows[:, :-1], rows[:, 1:])
        going = np.arange(len(data))
        while len(going):
            here, found = rows[going], ranks[going]
            at = found.argmin(axis=1)
            least = found[np.arange(len(going)), at]
            some = least < self._none
            going, here, found, at, least = going[some], here[some], found[some], at[some], least[some]
            if not len(going):
                break
            k, place = np.arange(len(going)), np.arange(here.shape[1])
            here = np.take_along_axis(here, np.minimum(place + (place > at[:, None]), here.shape[1] - 1), 1)  # the last is always free
            here[k, at] = self._merged[least]
            place = place[:-1]
            found = np.take_along_axis(found, np.minimum(place + (place >= at[:, None]), len(place) - 1), 1)
            found[:, -1] = self._none
            found[k, at] = self._rank(here[k, at], here[k, at + 1])
            before = np.flatnonzero(at > 0)
            found[before, at[before] - 1] = self._rank(here[before, at[before] - 1], here[before, at[before]])
            rows[going], ranks[going] = here, found
        kept = rows >= 0
        ends = 4 * np.cumsum(kept.sum(axis=1))
        flat = rows[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Vocabulary:
    """Merges, ids and character classes of a vocabulary file of words in lower case, and what a process remembers of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.kind = _kind(tokenizer)
        model = made["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.ids = {token: i.to_bytes(4, "little") for token, i in model["vocab"].items()}
        self.lookahead = lookahead(merges)
        self.controls = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.joined = made["decoder"] is None  # tokens are joined by spaces then
        letters = _byte_letters()
        self._letter = dict(enumerate(letters))
        byte = {c: bytes([i]) for i, c in enumerate(letters)}
        as_bytes = (lambda t: t.encode()) if self.joined else (lambda t: b"".join(byte[c] for c in t) if all(c in byte for c in t) else t.encode())
        self.texts = {i: as_bytes(t) for t, i in (model["vocab"] | self.controls).items()}
        self._normalizer, self._splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._classes: dict[str, str] = {}
        self._kinds = _Kinds(self.kind_of)
        self._symbols: dict[str, list[str]] = {}
        self._together = _Together(merges, model["vocab"], letters, self.suffix)
        self.words = _Memory(lambda word: self.tokens(self.symbols(word), True))
        self.runs = _Memory(self._run)
        controls = "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))
        self.control = re.compile(controls) if controls else None

    def normal(self, piece: str) -> str:
        return self._normalizer.normalize_str(piece)

    def kind_of(self, c: str) -> str:
        """letter, number, space or other, as the library's splitter treats the character."""
        found = self._classes.get(c)
        if found is None:
            pieces = lambda x: len(self._splitter.pre_tokenize_str(x))
            found = self._classes[c] = "space" if not pieces(c) else "letter" if pieces("a" + c) == 1 else "other" if pieces("!" + c) == 1 else "number"
        return found

    def symbols(self, text: str) -> list[str]:
        """The letters of the text's bytes."""
        return list(text.encode().decode("latin-1").translate(self._letter))

    def tokens(self, symbols: list[str], last: bool) -> bytes:
        """Ids of whole symbols, the last of which ends the word."""
        if last and self.suffix:
            symbols = [*symbols[:-1], symbols[-1] + self.suffix]
        return b"".join(self.ids[t] for t in merged(symbols, self.ranks))

    def _run(self, run: str) -> bytes:
        if len(run) <= SHORT:
            return b"".join(map(self.words.__getitem__, self._split(run)))
        machine = Transducer(self)
        return machine.feed(run) + machine.finish()

    def _split(self, run: str) -> list[str]:
        """The words of a short run."""
        if run.isascii() and run.isprintable():  # composed already, and its words by one pattern
            return _ASCII.findall(run.lower())
        whole = self.normal(run)
        if "'" not in whole:
            return [whole[m.start() : m.end()] for m in _KINDS.finditer(whole.translate(self._kinds))]
        machine = _Splitter(self)
        machine.feed(run)
        machine.finish()
        return machine.words

    def prepare(self, texts: list[str]) -> None:
        """Remember the short runs and words of the texts; the words that are new are merged together."""
        new = {run for text in texts if len(text) <= WINDOW for run in _RUN.findall(text) if len(run) <= SHORT and not self.runs.has(run)}
        split = {run: self._split(run) for run in new}
        words = sorted({w for ws in split.values() for w in ws if not self.words.has(w)}, key=len)
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            for word, ids in zip(some, self._together(some), strict=True):
                self.words.keep(word, ids)
        for run, ws in split.items():
            self.runs.keep(run, b"".join(map(self.words.__getitem__, ws)))


class Transducer:
    """Text pieces in, ids (unsigned 32-bit, little-endian) of the tokens that have become final out."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.kind != "word":
            raise ValueError("the transducer reads vocabularies of words in lower case")
        self._v = vocabulary
        self._raw = ""  # may still compose
        self._held = ""  # an apostrophe whose ending isn't known
        self._open = ""  # class of the open word
        self._word: list[str] = []  # what is read of it, while it is short
        self._symbols: list[str] | None = None  # since its last final token, once it is long

    @property
    def held(self) -> int:
        """Characters and symbols that wait."""
        return len(self._raw) + len(self._held) + sum(map(len, self._word)) + len(self._symbols or ())

    def feed(self, piece: str) -> bytes:
        raw = self._raw + piece
        cut = len(raw) - 1
        while cut > 0 and not _begins(raw[cut]):
            cut -= 1
        if cut <= 0:
            self._raw = raw
            return b""
        self._raw = raw[cut:]
        return b"".join(self._classes(self._v.normal(raw[:cut]), False))

    def finish(self) -> bytes:
        """What is left; the machine can begin anew."""
        raw, self._raw = self._raw, ""
        return b"".join([*self._classes(self._v.normal(raw) if raw else "", True), self._ended()])

    def _classes(self, text: str, end: bool) -> Iterator[bytes]:
        text, self._held = self._held + text, ""
        at, n = 0, len(text)
        while at < n:
            kind = self._v.kind_of(text[at])
            if self._open:
                stop = at
                while stop < n and self._v.kind_of(text[stop]) == self._open:
                    stop += 1
                if stop > at:
                    yield self._grown(text[at:stop])
                if stop < n:
                    yield self._ended()
                at = stop
            elif kind == "space":
                at += 1
            elif text[at] == "'" and n - at < 3 and not end:
                self._held = text[at:]
                return
            elif kind == "other" and (ending := next((e for e in ENDINGS if text.startswith(e, at)), "")):
                yield self._ids(ending)
                at += len(ending)
            elif kind == "number":
                yield self._ids(text[at])
                at += 1
            else:
                self._open = kind

    def _grown(self, part: str) -> bytes:
        """The final tokens of the open word after another part of it."""
        out = []
        for at in range(0, len(part), STEP):
            piece = part[at : at + STEP]
            if self._symbols is None:
                self._word.append(piece)
                if sum(map(len, self._word)) <= SHORT:
                    continue
                piece, self._word, self._symbols = "".join(self._word), [], []
            self._symbols += self._v.symbols(piece)
            out.append(self._final())
        return b"".join(out)

    def _final(self) -> bytes:
        known = len(self._symbols) - 1  # the newest one may end the word
        if known < self._v.lookahead + STEP:
            return b""
        out, end, size = [], 0, 0
        suffix = self._v.suffix
        for token in merged(self._symbols[:known], self._v.ranks):
            size += len(token)  # one letter is one symbol: no token here ends a word
            if size > known - self._v.lookahead:
                break
            out.append(self._v.ids[token])
            end = size
        assert not suffix or end <= known
        del self._symbols[:end]
        return b"".join(out)

    def _ended(self) -> bytes:
        word, symbols = "".join(self._word), self._symbols
        self._open, self._word, self._symbols = "", [], None
        if symbols is not None:
            return self._v.tokens(symbols, True)
        return self._ids(word) if word else b""

    def _ids(self, word: str) -> bytes:
        """Ids of a whole word."""
        return self._v.words[word]


class _Splitter(Transducer):
    """The words of a short run instead of their ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.words: list[str] = []

    def _ids(self, word: str) -> bytes:
        self.words.append(word)
        return b""


def _pieces(v: Vocabulary, text: str, begin: int, stop: int) -> Iterator[bytes]:
    """Ids of text[begin:stop], which has no control string: windows of whole runs, and a run over a window piece by piece."""
    while begin < stop:
        end = min(begin + WINDOW, stop)
        if end < stop:
            end = max(text.rfind(c, begin, end) for c in _SPACES) + 1
        if end > begin:
            yield b"".join(map(v.runs.__getitem__, _RUN.findall(text, begin, end)))
            begin = end
            continue
        machine = Transducer(v)
        space = re.compile(r"[\x20\x09-\x0D]").search(text, begin, stop)
        end = space.start() if space else stop
        for at in range(begin, end, WINDOW):
            yield machine.feed(text[at : min(at + WINDOW, end)])
        yield machine.finish()
        begin = end


def ids_of(v: Vocabulary, text: str) -> Iterator[bytes]:
    """Ids of a text, as they become final."""
    at = 0
    for found in v.control.finditer(text) if v.control else ():
        yield from _pieces(v, text, at, found.start())
        yield v.controls[found[0]].to_bytes(4, "little")
        at = found.end()
    yield from _pieces(v, text, at, len(text))


class Decoder:
    """Ids in, text out: bytes of the tokens, and from them the characters that are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self._v = vocabulary
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def feed(self, ids: Iterable[int]) -> str:
        found = [b for b in map(self._v.texts.get, ids) if b is not None]
        if not found:
            return ""
        data = (b" " if self._v.joined else b"").join(found)
        if self._v.joined and self._begun:
            data = b" " + data
        self._begun = True
        return self._machine.decode(data)

    def finish(self) -> str:
        self._begun = False
        return self._machine.decode(b"", True)


@cache
def vocabulary(path: str) -> Vocabulary:
    """The process's vocabulary of a file; kept from task to task."""
    return Vocabulary(path)


def text_of(v: Vocabulary, ids: bytes) -> str:
    """The text of ids (unsigned 32-bit, little-endian)."""
    machine = Decoder(v)
    parts = [machine.feed(memoryview(ids[at : at + 4 * IDS]).cast("I")) for at in range(0, len(ids), 4 * IDS)]
    return "".join([*parts, machine.finish()])


def encoded(text: str | Column, path: str) -> Column:
    """Ids of each text as bytes: unsigned 32-bit, little-endian."""

    @pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for texts in batches:
            v.prepare(list(texts))
            yield pd.Series([b"".join(ids_of(v, x)) for x in texts], dtype=object)

    return run(text_or_empty(text))


def decoded(ids: str | Column, path: str) -> Column:
    """The text of each row of ids; null ids have the empty text."""

    @pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for rows in batches:
            yield pd.Series([text_of(v, bytes(x)) if x is not None else "" for x in rows], dtype=object)

    return run(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, ids, decoded: each text's ids, and the text that these decode to, in one pass of ROWS texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                v.prepare(texts)
                ids = [b"".join(ids_of(v, x)) for x in texts]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([text_of(v, x) for x in ids], pa.string())], names=["key", "ids", "decoded"])

    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return documents.select(F.col(key), text_or_empty(text)).mapInArrow(run, schema)
