"""Token-id files: concatenated ids in ascending key order, with document boundaries in Elias-Fano code.

A file holds one range of keys:

    magic "LTOKEF1\\0", then unsigned 64-bit little-endian: documents n, ids u, bytes of an id, low bits l, bytes of each part
    low parts   n numbers of l bits, packed
    high parts  bit (boundary >> l) + i is 1 for the i-th boundary, in unary code: 2 n + (u >> l) bits at most
    samples     the bit position of every 256th 1 in the high parts, from which select() starts
    keys        n signed 64-bit numbers, and a bit each that says that the key is null
    ids         u numbers

Boundary i is the end of document i, so that select(i - 1) is its start: 2 + log2(u / n) bits a document and no table of
64-bit offsets. Ids of two bytes serve vocabularies up to 65,536.

Files are written by the tasks to a shared folder, each attempt of a task under a name of its own, and the manifest has
those of the attempts that counted: a lost executor's task writes its file again, and what it left is never read. Defined results: null and empty texts have the end id only; null keys come first;
equal keys are in the order of the hash of their text; an empty table gives files without documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loomdoc.llm.common import OWN, fresh_path, text_or_empty, written
from loomdoc.llm.tokens import as_u32, encoder

MAGIC = b"LTOKEF1\0"
HEAD = "<9Q"
EVERY = 256
ROWS = 512  # texts that are encoded at a time
SLICE = 1 << 16  # low parts that are packed at a time


class EliasFano:
    """A rising sequence of n numbers up to u, with select() and without a table of the numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self._low, self._high, self._samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, upper: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (upper // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        low = [np.zeros(0, np.uint8)]
        for at in range(0, n, SLICE):  # a multiple of eight, so that slices end at bytes
            part = ((values[at : at + SLICE, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low.append(np.packbits(part.ravel(), bitorder="little"))
        return cls(n, bits, np.concatenate(low), np.packbits(high, bitorder="little"), places[::EVERY].astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th number, from 0: the sampled position nearest below, then 1s counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self._samples[i // EVERY]), i % EVERY
        if left:
            byte = place // 8
            ones = np.bitwise_count(self._high[byte : byte + 8 * EVERY])
            ones[0] = int(self._high[byte] >> (place % 8)).bit_count()
            total = np.cumsum(ones, dtype=np.int64)
            while total[-1] <= left:  # a long gap
                more = np.bitwise_count(self._high[byte + len(total) : byte + 2 * len(total)])
                total = np.concatenate([total, total[-1] + np.cumsum(more, dtype=np.int64)])
            k = int(np.searchsorted(total, left, "right"))
            byte_value = int(self._high[byte + k]) >> (place % 8) << (place % 8) if k == 0 else int(self._high[byte + k])
            for _ in range(left - (int(total[k - 1]) if k else 0)):
                byte_value &= byte_value - 1
            place = 8 * (byte + k) + (byte_value & -byte_value).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low_part(i)

    def _low_part(self, i: int) -> int:
        first = i * self.low_bits
        piece = self._low[first // 8 : (first + self.low_bits + 7) // 8].tobytes()
        return int.from_bytes(piece, "little") >> first % 8 & (1 << self.low_bits) - 1

    def block(self, first: int, count: int) -> np.ndarray:
        """The numbers first, first + 1, ...; decoded together."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.int64)
        start = int(self._samples[first // EVERY]) // 8
        beyond = -(-(first + count) // EVERY)
        last = int(self._samples[beyond]) // 8 + 1 if beyond < len(self._samples) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[start:last], bitorder="little")) + 8 * start
        at = int(np.searchsorted(ones, int(self._samples[first // EVERY]))) + first % EVERY
        places = ones[at : at + count]
        begin = first * self.low_bits
        low = np.unpackbits(self._low[begin // 8 : ((first + count) * self.low_bits + 7) // 8], bitorder="little")[begin % 8 :][: count * self.low_bits]
        low = low.reshape(count, self.low_bits) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0
        return ((places - np.arange(first, first + count)) << self.low_bits) | low

    def parts(self) -> list[bytes]:
        return [self._low.tobytes(), self._high.tobytes(), self._samples.tobytes()]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


MANIFEST = "shard long, path string, documents long, ids long"


def _writer(folder: str, vocabulary: str, end_id: int, width: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for the task's range: ids go to a side file as they come, the boundaries are kept until the end."""
        tokens = encoder(vocabulary, width)
        shard = TaskContext.get().partitionId()
        store, root = _open(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ltok"
        own = f"{root}/{name}"
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        end = int(end_id).to_bytes(width, "little")
        with store.open_output_stream(own + ".ids") as ids:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    encoded = tokens.encode(part.column(1).to_pylist())
                    lengths.append(np.array([len(x) // width + 1 for x in encoded], np.int64))
                    keys.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                    nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                    ids.write(b"".join(x + end for x in encoded))
        ends = np.cumsum(np.concatenate(lengths or [np.zeros(0, np.int64)]))
        n, total = len(ends), int(ends[-1]) if len(ends) else 0
        bounds = EliasFano.encode(ends, total)
        parts = [*bounds.parts(), np.concatenate(keys or [np.zeros(0, "<i8")]).tobytes(), np.packbits(np.concatenate(nulls or [np.zeros(0, bool)])).tobytes()]
        with store.open_output_stream(own) as out, store.open_input_stream(own + ".ids") as ids:
            out.write(MAGIC + struct.pack(HEAD, n, total, width, bounds.low_bits, *map(len, parts)))
            for part in parts:
                out.write(part)
            while piece := ids.read(1 << 22):
                out.write(piece)
        store.delete_file(own + ".ids")
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["shard", "path", "documents", "ids"])

    return write


def write_tokens(documents: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files; the result is their manifest, a row each (MANIFEST), in the order of the keys."""
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows = documents.select(F.col(key).cast("long").alias(OWN + "key"), text_or_empty(text).alias(OWN + "text"))
    ordered = rows.repartitionByRange(OWN + "key").sortWithinPartitions(F.col(OWN + "key").asc_nulls_first(), F.xxhash64(OWN + "text"), OWN + "text")
    return written(ordered.mapInArrow(_writer(folder, vocabulary, end_id, width), MANIFEST), "tokens-manifest")


class TokenFile:
    """Random access to one file: key and ids of document i, from offsets that select() gives."""

    def __init__(self, path: str):
        store, root = _open(path)
        self._file = store.open_input_file(root)
        if self._file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.n, self.ids, self.width, bits, *sizes = struct.unpack(HEAD, self._file.read(struct.calcsize(HEAD)))
        low, high, samples, keys, nulls = (self._file.read(x) for x in sizes)
        self.bounds = EliasFano(self.n, bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u8"))
        self.keys = np.frombuffer(keys, "<i8")
        self.null = np.unpackbits(np.frombuffer(nulls, np.uint8))[: self.n].astype(bool)
        self._at = len(MAGIC) + struct.calcsize(HEAD) + sum(sizes)

    def document(self, i: int) -> np.ndarray:
        start = self.bounds.select(i - 1) if i else 0
        return self.span(start, self.bounds.select(i))

    def span(self, start: int, end: int) -> np.ndarray:
        self._file.seek(self._at + start * self.width)
        return as_u32(self._file.read((end - start) * self.width), self.width)

    def close(self) -> None:
        self._file.close()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(path)
            for first in range(0, file.n, 4096):
                ends = file.bounds.block(first, 4096)
                starts = np.concatenate([[file.bounds.select(first - 1) if first else 0], ends[:-1]]).astype(np.int64)
                ids = file.span(int(starts[0]), int(ends[-1]))
                base = int(starts[0])
                crc = [zlib.crc32(ids[s - base : e - base].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = pa.array(file.keys[first : first + 4096], pa.int64(), mask=file.null[first : first + 4096])
                yield pa.record_batch([keys, pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])
            file.close()


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per document, read from the files: key, start over all files, n_tokens, ids_crc32.

    The window without partitions runs over the manifest, which has a row per file.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.cast("long").alias("before")).repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return files.mapInArrow(_reader, T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


__all__ = ["EliasFano", "TokenFile", "read_tokens", "write_tokens"]
