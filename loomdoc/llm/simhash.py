"""SimHash near-duplicates by vantage-point trees over Hamming space.

Fingerprints are 64 bits over the word shingles of a text. Two of them that differ in at most `radius` bits differ in at
most `radius // parts` bits of one of `parts` bit ranges, so each range has a vantage-point tree of its own, built from a
bounded sample of the fingerprints: an inner node splits what reaches it by the Hamming distance to a vantage point,
within its bit range. A fingerprint has one home leaf in each tree, and by the triangle inequality its partners have
theirs among the leaves whose distance bounds its small ball overlaps; it visits those that come after its home, as a
partner in an earlier leaf visits its own. So every pair meets in a leaf, and no pair is looked for elsewhere.

A leaf's home fingerprints are split into blocks of bounded size, each held by one task at a time, past which the leaf's
other fingerprints and its visitors stream; hot leaves only have more blocks. A block prunes once more with a vantage
point of its own over all 64 bits before it compares exactly. What leaves a block is a spanning forest of its links, not
the pairs. Components come from alternating large-star and small-star steps, each a written table, until nothing changes.

Equal texts have equal fingerprints and are one point of the search; the trees are small and the only thing that the
driver builds, from a sample whose size follows their leaves (8 MB of fingerprints at most).

Near copies (`representatives`) are links of a Jaccard similarity of 4/5 or more over distinct five-word shingles, and
the prints only find candidates for them: the trees' links, and texts that share one of BANDS hashes of MinHashes. Every
candidate is confirmed on the shingles' 64-bit hashes before it counts. The trees' links come first; then, within blocks
of every bucket that still has different components, the nearest pairs are confirmed first and those that a confirmed
path joins aren't tried, so that what leaves a block are no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import OWN, released, text_or_empty, written

BLOCK = 4096  # home fingerprints that a task holds at a time
LEAF = 2000  # home fingerprints that a leaf is meant for
DEPTH = 18  # levels of a tree at most: trees of 4 MB each, a sample of 8 MB; for leaves of LEAF up to 500 million prints
SAMPLE = 4  # prints of the sample for each leaf
LEAVES = 100_000  # leaves whose counts are broadcast at most; with more of them the join shuffles
FOREST = 1 << 20  # edges that are contracted at a time
HOT = 4096  # a point with more than one in HOT of all edges is broadcast, not shuffled
PAIRS = 1 << 19  # pairs that a block compares at a time: their numbers, not those of all that are near, take memory
SHINGLES = 1 << 15  # hashes that are counted at a time
CELL, CELL_BYTES = 512, 1 << 24  # members of a bucket that a task holds at a time, and bytes of their sets
BANDS, MINIMA = 25, 5  # a pair at a similarity of 0.8 shares no band in 5 of 100,000 cases: (1 - 0.8 ** 5) ** 25
_FLIPS, _FACTORS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text: a bit is 1 if over half of the shingles' XXH64 (seed 42) have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + SHINGLES], stops[at : at + SHINGLES], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _majority(digests: bytes, width: int) -> np.ndarray:
    """The bits that over half of the digests of `width` bytes have, as 64-bit words."""
    table = np.frombuffer(digests, np.uint8).reshape(-1, width)
    counts = np.zeros(8 * width, np.int64)
    for at in range(0, len(table), SHINGLES):
        counts += np.unpackbits(table[at : at + SHINGLES], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(table), bitorder="little").view("<u8")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = 5) -> set[bytes]:
    """The distinct shingles of `width` words; of fewer words all of them, and of none the empty one."""
    line = b" ".join(words)
    if len(words) <= width:
        return {line}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    return {line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)}


def _bands(hashes: np.ndarray) -> list[int]:
    """BANDS hashes of MINIMA MinHashes each, as signed 64-bit numbers."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    found = [xxhash.xxh64_intdigest(least[k * MINIMA : (k + 1) * MINIMA].tobytes(), k) for k in range(BANDS)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def sketch(text: str | None, width: int = 5) -> tuple[int, bytes, list[int]]:
    """Two SimHashes, 64 bits over the distinct words and 256 over the distinct shingles of `width` words, and the shingles' bands."""
    words = _words(text)
    digest, wide = xxhash.xxh64_digest, xxhash.xxh3_128_digest
    digests = b"".join([wide(x, seed) for x in shingles(words, width) for seed in (1, 2)])
    bands = _bands(np.frombuffer(digests, "<u8").reshape(-1, 4)[:, 0])
    if not words:
        return 0, bytes(32), bands
    short = _majority(b"".join([digest(w, 42) for w in set(words)]), 8)
    return int(short[0]), _majority(digests, 32).tobytes(), bands


def shingle_set(text: str | None, width: int = 5) -> bytes:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(x) for x in shingles(_words(text), width)], "<u8")).tobytes()


_SKETCH = T.StructType([T.StructField("print", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@pandas_udf(_SKETCH)
def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [sketch(x) for x in texts]
        yield pd.DataFrame({"print": np.array([p for p, _, _ in found], np.uint64).view(np.int64), "wide": [w for _, w, _ in found], "bands": [b for _, _, b in found]})


@pandas_udf(T.BinaryType())
def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingle_set(x) for x in texts], dtype=object)


@pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def simhash(text: str | Column) -> Column:
    """The fingerprint of each text as a signed 64-bit number."""
    return _fingerprints(F.col(text) if isinstance(text, str) else text)


def ranges(parts: int) -> list[int]:
    """Masks of `parts` bit ranges that together have all 64 bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Tree:
    """Complete vantage-point tree of one bit range: node i has children 2 i + 1 (distance <= bounds[i]) and 2 i + 2."""

    mask: int
    depth: int
    points: np.ndarray
    bounds: np.ndarray

    @classmethod
    def build(cls, mask: int, depth: int, sample: np.ndarray, seed: int = 7) -> Tree:
        """Vantage points are drawn from what of the sample reaches a node; the bound is the median distance."""
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        points, bounds = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        reach: dict[int, np.ndarray] = {0: sample}
        for node in range(inner):
            here = reach.pop(node, sample[:0])
            # without enough of the sample, a random point with half the range's bits as the bound
            points[node] = here[rng.integers(len(here))] if len(here) else rng.integers(0, 1 << 64, dtype=np.uint64)
            distance = np.bitwise_count((here ^ points[node]) & np.uint64(mask)).astype(np.int64)
            bounds[node] = np.median(distance) if len(here) > 1 else mask.bit_count() // 2
            if len(here) and bounds[node] >= distance.max() and distance.min() < distance.max():
                bounds[node] -= 1
            reach[2 * node + 1], reach[2 * node + 2] = here[distance <= bounds[node]], here[distance > bounds[node]]
        return cls(mask, depth, points, bounds)

    def route(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home leaf of each fingerprint; then, as (row, leaf), the later leaves that a ball of the radius overlaps."""
        row = np.arange(len(prints))
        node = np.zeros(len(prints), np.int64)
        home = np.ones(len(prints), bool)
        for _ in range(self.depth):
            distance = np.bitwise_count((prints[row] ^ self.points[node]) & np.uint64(self.mask)).astype(np.int64)
            bound = self.bounds[node]
            inner = distance <= bound
            # visitors go wherever the ball reaches; a home row sends visitors to the later side only
            to_left = np.where(home, inner, distance - radius <= bound)
            to_right = np.where(home, ~inner, distance + radius > bound)
            sent = home & inner & (distance + radius > bound)
            node = np.concatenate([2 * node[to_left] + 1, 2 * node[to_right] + 2, 2 * node[sent] + 2])
            row, home = np.concatenate([row[to_left], row[to_right], row[sent]]), np.concatenate([home[to_left], home[to_right], np.zeros(int(sent.sum()), bool)])
        leaf = node - ((1 << self.depth) - 1)
        homes = np.empty(len(prints), np.int64)
        homes[row[home]] = leaf[home]
        return homes, row[~home], leaf[~home]


def _route(trees: list[Tree], radius: int, depth: int):
    """Rows (leaf, visitor, print, id, wide) of every point: a home in every tree, and its visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                prints = part.column(0).to_numpy().view(np.uint64)
                for k, tree in enumerate(trees):
                    homes, row, leaf = tree.route(prints, radius)
                    leaves = np.concatenate([homes, leaf])
                    visitor = np.concatenate([np.zeros(len(homes), bool), np.ones(len(leaf), bool)])
                    points = part.take(pa.array(np.concatenate([np.arange(len(homes)), row])))
                    yield pa.record_batch([pa.array(leaves + (k << depth), pa.int32()), pa.array(visitor), *points.columns], names=["leaf", "visitor", "print", "id", "wide"])

    return run


@dataclass
class _Points:
    """Some points: prints, names and, where links also need them to be near, wide prints (a row of words each)."""

    prints: np.ndarray
    ids: np.ndarray
    wide: np.ndarray | None

    @classmethod
    def of(cls, batch: pa.RecordBatch, first: int) -> _Points:
        wide = batch.column(first + 2)
        return cls(batch.column(first).to_numpy().view(np.uint64), batch.column(first + 1).to_numpy(), None if wide.null_count else np.frombuffer(b"".join(wide.to_pylist()), "<u8").reshape(len(wide), -1))

    def __getitem__(self, rows) -> _Points:
        return _Points(self.prints[rows], self.ids[rows], None if self.wide is None else self.wide[rows])

    def __len__(self) -> int:
        return len(self.prints)


def _joined(parts: list[_Points]) -> _Points:
    wide = None if parts[0].wide is None else np.concatenate([p.wide for p in parts])
    return _Points(np.concatenate([p.prints for p in parts]), np.concatenate([p.ids for p in parts]), wide)


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the larger root of each pair to the smaller one, and flatten, until all pairs share theirs."""
    while True:
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


class _Block:
    """Home points in the order of the distance to a vantage point, with a union-find over them."""

    def __init__(self, points: _Points, radius: int, wide_radius: int):
        self.radius, self.wide_radius = radius, wide_radius
        self.vantage = points.prints[0]
        distance = np.bitwise_count(points.prints ^ self.vantage)
        order = np.argsort(distance, kind="stable")
        self.points, distance = points[order], distance[order]
        # where the ring of distances from d - radius to d + radius begins and ends, for every d
        self.begin = np.searchsorted(distance, np.arange(65) - radius, "left")
        self.end = np.searchsorted(distance, np.arange(65) + radius, "right")
        self.parent = np.arange(len(points))

    def meet(self, others: _Points) -> tuple[np.ndarray, np.ndarray]:
        """Links of the others, one each, to the block; what they link within the block is united."""
        distance = np.bitwise_count(others.prints ^ self.vantage).astype(np.int64)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for d in np.unique(distance):
            begin, end = self.begin[d], self.end[d]
            here = others[distance == d]
            step = 1 + PAIRS // max(1, end - begin)
            for at in range(0, len(here), step):
                some = here[at : at + step]
                i, j = np.nonzero(np.bitwise_count(some.prints[:, None] ^ self.points.prints[None, begin:end]) <= self.radius)
                j = j + begin
                if self.points.wide is not None and len(i):
                    near = np.concatenate([np.bitwise_count(some.wide[i[k : k + 65536]] ^ self.points.wide[j[k : k + 65536]]).sum(axis=1) <= self.wide_radius for k in range(0, len(i), 65536)])
                    i, j = i[near], j[near]
                if not len(i):
                    continue
                new = np.concatenate([[True], i[1:] != i[:-1]])
                first = j[new][np.cumsum(new) - 1]
                _unite(self.parent, first, j)
                left.append(some.ids[i[new]])
                right.append(self.points.ids[first[new]])
        if not left:
            return others.ids[:0], others.ids[:0]
        a, b = np.concatenate(left), np.concatenate(right)
        return a[a != b], b[a != b]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.parent != np.arange(len(self.parent))
        return self.points.ids[own], self.points.ids[self.parent[own]]


def _links(radius: int, wide_radius: int):
    """Links of the sorted rows (leaf, block, role, print, id, wide): role 0 is the block itself, later ones stream past it."""

    def out(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        waiting: list[_Points] = []
        block: _Block | None = None
        for batch in batches:
            leaf, number, role = (batch.column(i).to_numpy() for i in range(3))
            points = _Points.of(batch, 3)
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
                if a == b:
                    continue
                if (leaf[a], number[a]) != at:
                    if waiting:  # nothing streams past the former block
                        block = _Block(_joined(waiting), radius, wide_radius)
                        yield out(block.meet(block.points))
                    if block:
                        yield out(block.forest())
                    at, waiting, block = (leaf[a], number[a]), [], None
                if role[a] == 0:
                    waiting.append(points[a:b])
                    continue
                if waiting:
                    block, waiting = _Block(_joined(waiting), radius, wide_radius), []
                    yield out(block.meet(block.points))
                if block:
                    yield out(block.meet(points[a:b]))
        if waiting:
            block = _Block(_joined(waiting), radius, wide_radius)
            yield out(block.meet(block.points))
        if block:
            yield out(block.forest())

    return run


def links(points: DataFrame, radius: int = 4, parts: int = 3, wide_radius: int = 0, least_sample: int = 8192) -> DataFrame:
    """A spanning set of the links between points: columns a, b (their ids).

    points: print, id, wide. Links need prints within the radius and, where wide isn't null, wide prints within theirs.
    The trees' depth follows the number of points, and the sample that they are built from follows the depth: SAMPLE
    prints for each leaf, or `least_sample` where that is more, in expectation, and a quarter of the points at most.
    """
    spark = points.sparkSession
    n = points.count()
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / LEAF)), 0, DEPTH))
    share = min(0.25, max(least_sample, SAMPLE << depth) / max(1, n))
    whole = 1 << 30
    drawn = points.select("print").where(F.pmod(F.xxhash64("id"), F.lit(whole)) < F.lit(int(share * whole))) if depth else points.select("print").limit(0)
    vantage = np.sort(np.array([r["print"] for r in drawn.collect()], np.int64)).view(np.uint64)
    trees = [Tree.build(mask, depth, vantage) for mask in ranges(parts)]
    routed = points.select("print", "id", "wide").mapInArrow(_route(trees, radius // parts, depth), "leaf int, visitor boolean, print long, id long, wide binary")
    routed = written(routed, "simhash-routed")
    leaves = routed.where("not visitor").groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    if parts << depth <= LEAVES:
        leaves = F.broadcast(leaves)
    # an empty leaf has no block, and none of its visitors has a partner there
    rows = routed.join(leaves, "leaf").withColumn("own", F.when(~F.col("visitor"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    # a home point is in its block, and streams past the blocks before it; a visitor streams past all blocks
    rows = rows.withColumn("block", F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("own")))))
    rows = rows.select("leaf", "block", F.when(F.col("own") == F.col("block"), 0).otherwise(1).alias("role"), "print", "id", "wide")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf", "block").sortWithinPartitions("leaf", "block", "role")
    return dealt.mapInArrow(_links(radius, wide_radius), "a long, b long").distinct()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each run of about FOREST edges (u, v): every point with the smallest one that its run links to it."""

    def forest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(2))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = np.arange(len(names))
        _unite(parent, at[: len(u)], at[len(u) :])
        own = parent != np.arange(len(names))
        return pa.record_batch([pa.array(names[own]), pa.array(names[parent[own]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= FOREST:
            yield forest(held)
            held = []
    if held:
        yield forest(held)


def _by_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Rows joined with the groups (key, size, ...) that they are counted in; `total` is the number of rows counted.

    Groups of more than one in HOT of them are fewer than HOT, so that they are broadcast and their keys are known to the
    driver: the join that shuffles has no hot key.
    """
    groups = written(groups, "simhash-groups")
    large = F.col("size") > total // HOT
    hot = F.col(key).isin([r[0] for r in groups.where(large).select(key).collect()])
    return rows.where(hot).join(F.broadcast(groups.where(large)), key).unionByName(rows.where(~hot).join(groups.where(~large), key))


def _to_least(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n edges (u, v) with the smallest neighbour m of u; and u with m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    return _by_group(edges, least, "u", n), least


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The smallest name of every linked point's component: columns v, root.

    Edges are contracted to forests within partitions, then large-star and small-star steps alternate until nothing
    changes; with a guard of `rounds`, an error tells that they are not enough.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = written(pairs.mapInArrow(_forests, "u long, v long").distinct(), "star")
    was = _digest(edges)
    done = 0
    while was[0]:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components are not stable after {rounds} rounds")
        # large star: larger neighbours go to the smallest neighbour
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to_least, _ = _to_least(both, 2 * was[0])
        large = to_least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = written(large, "star-large")
        # small star: smaller neighbours and the point itself go to the smallest of them
        to_least, least = _to_least(large, was[0])
        small = to_least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        small = written(small.where("u <> v").distinct(), "star")
        now = _digest(small)
        released(edges, large)
        edges, done = small, done + 1
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (a, b, set of a, set of b), the pairs with a Jaccard similarity of 4/5 at least."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            near.append(5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and _alike(x, y))
        kept = batch.filter(pa.array(near, pa.bool_()))
        yield pa.record_batch([kept.column(0), kept.column(1)], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
    return written(both.select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long"), name)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 at least."""
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 5 * both >= 4 * (len(x) + len(y) - both)


class _Cell:
    """Members of a bucket with their sets, and a union-find over the components that they have been found in so far."""

    def __init__(self, radius: int):
        self.radius = radius
        self.ids, self.roots, self.sizes = (np.zeros(0, np.int64) for _ in range(3))
        self.wide = np.zeros((0, 4), np.uint64)
        self.sets: list[np.ndarray] = []
        self.up: dict[int, int] = {}

    def add(self, ids: np.ndarray, roots: np.ndarray, wide: np.ndarray, sets: list[np.ndarray]) -> None:
        self.ids, self.roots, self.wide = np.concatenate([self.ids, ids]), np.concatenate([self.roots, roots]), np.concatenate([self.wide, wide])
        self.sets += [x.copy() for x in sets]  # what stays must not hold its whole batch
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in sets], np.int64)])

    def _root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def meet(self, ids: np.ndarray, roots: np.ndarray, wide: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        """Confirmed links of others to the members, no more than join components; the nearest are tried first."""
        sizes = np.array([len(x) for x in sets], np.int64)
        left, right = [], []
        step = 1 + (1 << 18) // len(self.ids)
        for at in range(0, len(ids), step):
            distance = np.zeros((len(ids[at : at + step]), len(self.ids)), np.uint16)
            for k in range(4):
                distance += np.bitwise_count(wide[at : at + step, k, None] ^ self.wide[None, :, k])
            own, others = sizes[at : at + step, None], self.sizes[None]
            near = (distance <= self.radius) & (roots[at : at + step, None] != self.roots[None]) & (5 * np.minimum(own, others) >= 4 * np.maximum(own, others))
            i, j = np.nonzero(near)
            order = np.argsort(distance[i, j], kind="stable")
            for a, b in zip((at + i[order]).tolist(), j[order].tolist(), strict=True):
                x, y = self._root(int(roots[a])), self._root(int(self.roots[b]))
                if x != y and _alike(sets[a], self.sets[b]):
                    self.up[max(x, y)] = min(x, y)
                    left.append(int(ids[a]))
                    right.append(int(self.ids[b]))
        return left, right


def _confirmed(radius: int):
    """Confirmed links of the sorted rows (bucket, block, role, id, root, wide, set): role 0 is the block, past which role 1 streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        cell = _Cell(radius)
        for batch in (whole.slice(k, CELL) for whole in batches for k in range(0, whole.num_rows, CELL)):
            bucket, number, role, ids, roots = (batch.column(i).to_numpy() for i in range(5))
            wide = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8").reshape(-1, 4)
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(6)]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if (bucket[a], number[a]) != at:
                    at, cell = (bucket[a], number[a]), _Cell(radius)
                part = ids[a:b], roots[a:b], wide[a:b], sets[a:b]
                if role[a] == 0:
                    cell.add(*part)
                if len(cell.ids):
                    left, right = cell.meet(*part)
                    if left:
                        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _bucket_links(members: DataFrame, points: DataFrame, sets: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """Confirmed links (a, b) between a bucket's members in different components.

    A bucket is held in blocks of CELL members and CELL_BYTES of sets, which hold each as a task's row group; later members
    stream past them. Nothing leaves a block but a forest of confirmed links, however many of its pairs are near.
    """
    named = members.join(roots.select(F.col("v").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = written(named.join(sets.select("id", F.octet_length("set").alias("bytes")), "id"), "simhash-named")
    buckets = named.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"), F.sum("bytes").alias("all")).where("least < most")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(CELL)), F.ceil(F.col("all") / F.lit(CELL_BYTES)))
    rows = _by_group(named, buckets, "bucket", named.count()).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.join(points.select("id", "wide"), "id").join(sets, "id")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), "own")))
    rows = rows.select("bucket", "block", F.when(F.col("own") == F.col("block"), 0).otherwise(1).alias("role"), "id", "root", "wide", "set")
    dealt = rows.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "block").sortWithinPartitions("bucket", "block", "role")
    return dealt.mapInArrow(_confirmed(radius), "a long, b long").distinct()


def similar_links(points: DataFrame, documents: DataFrame, row: str, text: str, radius: int, parts: int, wide_radius: int) -> DataFrame:
    """A spanning set of the points' links by exact similarity: columns a, b. `documents` has the points' texts by `row`."""
    tried = written(links(points, radius, parts, wide_radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-tried")
    buckets = points.select("id", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(_by_group(buckets, sizes, "bucket", BANDS * points.count()).select("bucket", "id"), "simhash-buckets")
    needed = members.select("id").unionAll(tried.select("a")).unionAll(tried.select("b")).distinct()
    needed = points.select("id", F.col("first.row").alias(row)).join(needed, "id", "left_semi")
    sets = written(documents.select(row, text).join(needed, row).select("id", _sets(F.col(text)).alias("set")), "simhash-sets")
    found = _verified(tried, sets, "simhash-links")
    more = written(_bucket_links(members, points, sets, components(found), wide_radius), "simhash-links")
    return found.unionAll(more)


def _points(rows: DataFrame, *more: str) -> DataFrame:
    """Columns id, first (null, key, row), size, print, wide and `more`: of each distinct id, the smallest key, its row, the rows.

    rows: key, row, id, print, wide; equal ids are one point. Partial aggregates meet copies before the shuffle, so that
    a large group of them is one row per task; keys that are null come last.
    """
    first = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "row")).alias("first")
    return written(rows.groupBy("id").agg(first, F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("print", "wide", *more)]), "simhash-points")


def _named(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns id, component, first, size: of the component of each point, the smallest key and the first row; the point's rows."""
    roots = components(edges).select(F.col("v").alias("id"), "root")
    named = points.select("id", "first", F.col("size").alias("rows")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = written(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    both = _by_group(named, least, "root", named.count())
    return written(both.select("id", F.col("least.key").alias("component"), F.col("least.row").alias("first"), F.col("rows").alias("size")), "simhash-components")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, parts: int = 3) -> DataFrame:
    """A row per row of `documents`: key, fingerprint (signed 64 bits), component (the smallest key reachable)."""
    rows = documents.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), simhash(text).alias("id"))
    rows = written(rows.select("key", "row", "id", F.col("id").alias("print"), F.lit(None).cast("binary").alias("wide")), "simhash-prints")
    points = _points(rows)
    # the print of a large group of copies is a hot key
    found = _by_group(rows.select("key", "id"), _named(points, links(points, radius, parts)), "id", rows.count())
    return found.select(F.col("key").alias(key), F.col("id").alias("fingerprint"), "component")


def representatives(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 9, parts: int = 5, wide_radius: int = 72) -> DataFrame:
    """`documents` with one row of each group of near copies, that with the smallest key (of equal keys, any one row).

    Points are distinct texts. A link needs a Jaccard similarity of 0.8 over five-word shingles, see `similar_links`; its
    candidates have 256-bit SimHashes over the shingles within `wide_radius`, which similar ones exceed by chance only
    (39 bits are expected at 0.8, 48 for the shortest texts, 6 is the deviation). Tests hold the recall of given and planted pairs.
    """
    row, mark, found = OWN + "row", OWN + "id", OWN + "sketch"
    kept = documents.select("*", F.monotonically_increasing_id().alias(row), F.xxhash64(text_or_empty(text)).alias(mark), _sketches(F.col(text)).alias(found))
    kept = written(kept, "simhash-documents")
    rows = kept.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(mark).alias("id"), *[F.col(f"{found}.{c}").alias(c) for c in ("print", "wide", "bands")])
    points = _points(rows, "bands")
    named = _named(points, similar_links(points, kept, row, text, radius, parts, wide_radius))
    return kept.join(named.select(F.col("first").alias(row)).distinct(), row, "left_semi").drop(row, mark, found)
