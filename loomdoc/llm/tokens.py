"""Token ids of whole texts by a public tokenizer, with a per-process memory of chunks.

A chunk is what stands between two single spaces. The tokenizers of these two kinds end a word before such a space
whatever stands around it, so ids of a text are those of its chunks in a row; and a chunk of letters with punctuation
after it is two words, whose ids the tokenizer's own model gives without the rest of its steps. Texts in which white
space follows white space, or with other white space than spaces and line feeds, or with control strings of the
vocabulary, and all texts where the tokenizer is of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Chunks and words that a process remembers at most; beyond, it begins anew.
MEMORY = 1_000_000
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PLAIN = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,|!?;:#$%&*]*)")


def vocabulary_file(name: str) -> str:
    """The path of a public vocabulary file that is installed here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible, else the next free one."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


def _kind(tokenizer) -> str:
    """byte: bytes, split before spaces; word: lower case, white space dropped; other: neither of these."""
    made = json.loads(tokenizer.to_str())
    before, normal = made["pre_tokenizer"] or {}, made["normalizer"]
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
        return "byte"
    steps = [x["type"] for x in before.get("pretokenizers", [])]
    if steps == ["Split", "ByteLevel"] and normal and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "other"


class _Chunks(dict):
    """Ids of chunks; those of a new one are found when it is first asked for."""

    def __init__(self, find):
        self._find = find

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self._find(chunk)
        return found


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit (or 16-bit) bytes."""

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self.kind = _kind(self._tokenizer)
        self._letters = dict(enumerate(_byte_letters()))
        self._space = self._letters[32]
        self._chunks = _Chunks(self._chunk)
        self._words = _Chunks(self._word)
        self._code = {2: "H", 4: "I"}[width]
        self.width = width

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, word: str) -> bytes:
        """Ids of one word of the tokenizer, from its model."""
        letters = word.replace(" ", self._space) if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: of the words of a plain one, of others by the whole tokenizer."""
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return self._whole([chunk])[0]
        word, marks = plain.groups()
        ids = self._words[word.lower() if self.kind == "word" else word]
        return ids + self._words[marks] if marks else ids

    def _split(self, text: str) -> list[str] | None:
        """The text's chunks, or None where it has to be encoded whole."""
        if not text or _OTHER_SPACE.search(text) or "<|" in text:
            return None
        if self.kind == "word":  # which drops white space
            return text.split()
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        lines = text.split("\n")
        first, *rest = lines[0].split(" ")
        out = [first, *[" " + x for x in rest]]
        for line in lines[1:]:  # a line feed is a chunk of its own, and no space stands before the next one
            first, *rest = line.split(" ")
            out += ["\n", first, *[" " + x for x in rest]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; the same as `encode_batch(texts, add_special_tokens=False)` gives."""
        if self.kind == "other":
            return self._whole(texts)
        if len(self._chunks) > MEMORY or len(self._words) > MEMORY:
            self._chunks.clear()
            self._words.clear()
        split = [self._split(x) for x in texts]
        rest = iter(self._whole([x for x, chunks in zip(texts, split, strict=True) if chunks is None]))
        ids = self._chunks.__getitem__
        return [next(rest) if chunks is None else b"".join(map(ids, chunks)) for chunks in split]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 4) -> Encoder:
    """The process's encoder for a vocabulary file; kept from task to task."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def as_u32(ids: bytes, width: int) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, f"<u{width}").astype("<u4")
