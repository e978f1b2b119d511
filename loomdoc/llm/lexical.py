"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

The index is a table with a row per shard: a run of documents of one partition, closed at POSTINGS postings or DOCUMENTS
documents. A shard holds its terms in order and its postings as compressed sparse rows: where each term begins, the
documents of the term (16-bit numbers within the shard) and their impacts, the integers

    (1000000000 * tf) div (1000 * tf + 8 * m),   m = 100 - 75 + (75 * n * N) div L

of tf occurrences in a document of n terms, where the N documents with terms have L terms in all. Both are counted before,
so that impacts are final when a shard is built. Only the weight of a term, which depends on how many documents hold it,
comes in at the search: a pass over the shards' terms sums that up for the terms that are asked for.

A search goes term at a time: each item has a dense accumulator over the shard's documents, to which every term adds its
weighted impacts. The k-th largest score is found by argpartition; all documents that reach it are candidates, so that ties
are decided by their keys and not by the partition. A task keeps k rows of each item over all its shards, and a window over
these merges them. Items are searched in blocks of BLOCK bytes at most, measured before they reach the tasks.

Defined results: null and empty texts have no terms, count nowhere and are never found; null keys come after all others of
an equal score; repeated rows are documents of their own, and repeated items are answered each; an item without known
terms has no rows; no documents, no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.common import OWN, released, text_or_empty, words_of, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
POSTINGS, DOCUMENTS = 1 << 19, 1 << 14
BLOCK = 4 << 20  # bytes of terms that are searched at a time

SHARD = "documents int, keys binary, nulls binary, terms binary, starts binary, places binary, impacts binary"


class _Shard:
    """Documents and postings as they come."""

    def __init__(self, n_documents: int, n_terms: int):
        self._all = n_documents, n_terms
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self._terms: dict[bytes, int] = {}
        self._ids: list[int] = []
        self._counts: list[int] = []
        self._sizes: list[int] = []

    def add(self, key: int | None, words: list[bytes]) -> None:
        held = Counter(words)
        terms = self._terms
        self._ids += [terms.setdefault(t, len(terms)) for t in held]
        self._counts += held.values()
        self._sizes.append(len(held))
        self.keys.append(key)
        self.lengths.append(len(words))

    @property
    def full(self) -> bool:
        return len(self._ids) >= POSTINGS or len(self.keys) >= DOCUMENTS

    def row(self) -> tuple:
        n_documents, n_terms = self._all
        names = sorted(self._terms)
        rank = np.empty(len(names), np.int64)
        rank[[self._terms[t] for t in names]] = np.arange(len(names))
        term = rank[np.array(self._ids, np.int64)]
        place = np.repeat(np.arange(len(self.keys)), self._sizes)
        tf = np.array(self._counts, np.int64)
        norm = np.array([25 + 75 * n * n_documents // n_terms for n in self.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[place])
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        nulls = np.packbits([k is None for k in self.keys])
        return len(keys), keys.tobytes(), nulls.tobytes(), b"\n".join(names), starts.astype("<i8").tobytes(), place[order].astype("<u2").tobytes(), impact[order].astype("<i4").tobytes()


def _build(n_documents: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: _Shard) -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.binary()] * 6]
            names = [c.split()[0] for c in SHARD.split(", ")]
            return pa.record_batch([pa.array([x], t) for x, t in zip(shard.row(), kinds, strict=True)], names=names)

        shard = _Shard(n_documents, n_terms)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if words := words_of(text.as_py()):
                    shard.add(key.as_py(), words)
                    if shard.full:
                        yield out(shard)
                        shard = _Shard(n_documents, n_terms)
        if shard.keys:
            yield out(shard)

    return run


@dataclass(frozen=True)
class Index:
    """The shards, and how many documents with terms they have."""

    shards: DataFrame
    documents: int


def index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every row; two passes over the texts, the first of which only counts."""
    counted = documents.select(F.regexp_count(text_or_empty(text), F.lit(TERM)).cast("long").alias("n")).where("n > 0")
    n_documents, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = documents.select(F.col(key).cast("long"), text_or_empty(text))
    return Index(written(rows.mapInArrow(_build(n_documents, n_terms), SHARD), "lexical-index"), n_documents)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, terms, counts) of items."""
    for batch in batches:
        held = [Counter(words_of(x)) for x in batch.column(1).to_pylist()]
        terms = [b"\n".join(sorted(c)) for c in held]
        counts = [[c[t] for t in sorted(c)] for c in held]
        yield pa.record_batch([batch.column(0), pa.array(terms, pa.binary()), pa.array(counts, pa.list_(pa.int64()))], names=["row", "terms", "counts"])


def _held(wanted: list[bytes]):
    """Rows (term, documents) of a task's shards, for the terms that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for blob, starts in zip(batch.column(0), batch.column(1), strict=True):
                places = _places(blob.as_py().split(b"\n"), wanted)
                begin = np.frombuffer(starts.as_buffer(), "<i8")
                found.update({t: int(begin[i + 1] - begin[i]) for t, i in places.items()})
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "documents"])

    return run


def _places(terms: list[bytes], wanted: list[bytes]) -> dict[bytes, int]:
    """Where the wanted terms stand among the sorted ones."""
    at = {t: bisect_left(terms, t) for t in wanted}
    return {t: i for t, i in at.items() if i < len(terms) and terms[i] == t}


def best(scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0; equal ones by ascending key, null keys last."""
    least = 1
    if len(scores) > k:
        least = max(least, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]))
    found = np.flatnonzero(scores >= least)  # every one that ties with the k-th too
    return found[np.lexsort((keys[found], nulls[found], -scores[found]))][:k]


def _search(items: list[tuple[int, list[tuple[bytes, int]]]], k: int):
    """Rows (row, key, score) of the k best documents of a task's shards; items: row, and each term with its weight."""
    wanted = sorted({t for _, terms in items for t, _ in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard in zip(*batch.columns, strict=True):
                n = shard[0].as_py()
                keys = np.frombuffer(shard[1].as_buffer(), "<i8")
                nulls = np.unpackbits(np.frombuffer(shard[2].as_buffer(), np.uint8))[:n]
                at = _places(shard[3].as_py().split(b"\n"), wanted)
                starts, places, impacts = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(shard[4:], ("<i8", "<u2", "<i4"), strict=True))
                total = np.zeros(n, np.int64)
                for row, terms in items:
                    total[:] = 0
                    for term, weight in terms:
                        if (i := at.get(term)) is not None:
                            a, b = starts[i], starts[i + 1]
                            total[places[a:b]] += weight * impacts[a:b].astype(np.int64)
                    found = best(total, keys, nulls, k)
                    if len(found):
                        here = total[found], keys[found], nulls[found]
                        if row in top:
                            here = tuple(np.concatenate(x) for x in zip(top[row], here, strict=True))
                            kept = best(*here, k)
                            here = tuple(x[kept] for x in here)
                        top[row] = here
        rows = np.repeat(np.array(list(top), np.int64), [len(x[0]) for x in top.values()])
        score, key, null = (np.concatenate(x) if top else np.zeros(0, np.int64) for x in (zip(*top.values(), strict=True) if top else ((), (), ())))
        yield pa.record_batch([pa.array(rows), pa.array(key, mask=null.astype(bool)), pa.array(score)], names=["row", "key", "score"])

    return run


def weight(n_documents: int, holding: int) -> int:
    """The weight of a term that so many documents hold."""
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


def _block(found: Index, rows: list, k: int) -> DataFrame:
    """The best documents of a block of items."""
    items = [(r["row"], list(zip(bytes(r["terms"]).split(b"\n"), r["counts"], strict=True))) for r in rows if r["counts"]]
    wanted = sorted({t for _, terms in items for t, _ in terms})
    counts = found.shards.select("terms", "starts").mapInArrow(_held(wanted), "term binary, documents long").groupBy("term").agg(F.sum("documents").alias("n"))
    weights = {bytes(r["term"]): weight(found.documents, r["n"]) for r in counts.collect()}  # a row per wanted term
    weighted = [(row, [(t, weights[t] * c) for t, c in terms if weights.get(t)]) for row, terms in items]
    return found.shards.mapInArrow(_search([x for x in weighted if x[1]], k), "row long, key long, score long")


def search(found: Index, items: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Columns item, rank (from 1), key, score: the k best documents of each item."""
    named = written(items.select(F.col(item).alias("item"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("row")), "lexical-items")
    asked = written(named.select("row", "text").mapInArrow(_wanted, "row long, terms binary, counts array<long>"), "lexical-asked")
    size = F.octet_length("terms") + 16 * F.size("counts") + 64
    blocks = max(1, -(-(asked.agg(F.sum(size)).first()[0] or 0) // block))
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    parts = [written(_block(found, asked.where(number == i).collect(), k), "lexical-best") for i in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = every.select("*", F.row_number().over(order).alias(OWN + "rank")).where(F.col(OWN + "rank") <= k)
    released(asked)
    return ranked.join(named.select("row", "item"), "row").select(F.col("item").alias(item), F.col(OWN + "rank").alias("rank"), F.col("key").alias(key), "score")
