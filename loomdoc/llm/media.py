"""Media columns: payloads as FLAC streams in a binary column, decoded to PCM blocks with seekable offsets.

A payload's bytes become 8-bit samples by a table of ranks (the most frequent bytes of text are the smallest samples,
as companding does for loudness); the table stands in the stream's application block, so that what reads a stream
needs nothing else. Streams are written to the shared folder as a table and read back before anything is derived.

Defined results: null and empty texts are 64 zero bytes; repeated rows give repeated rows; equal texts have equal
streams; null keys are kept; a stream with a wrong checksum is an error. Very long texts are coded in chunks of frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.llm import flac
from loomdoc.llm.common import text_or_empty, written

UNIT = 64
SEGMENTS = 8
BYTES = 1 << 22  # payload that is coded at a time
#: Fixed value: frequent characters of text, in falling order; the other bytes follow in their own order.
FREQUENT = b" etaoinshrdlucmfwypvbgkqjxz,.\n\0-'\"ETAOINSHRDLUCMFWYPVBGKQJXZ0123456789\xc3"

# sample of each byte, and byte of each sample (both as unsigned bytes); ranks 0, 1, 2, ... are samples 0, -1, 1, ...
_RANKED = np.frombuffer(FREQUENT + bytes(sorted(set(range(256)) - set(FREQUENT))), np.uint8)
_RANK = np.empty(256, np.int64)
_RANK[_RANKED] = np.arange(256)
TO_SAMPLE = ((_RANK >> 1) ^ -(_RANK & 1)).astype(np.int8)
EXPAND = np.empty(256, np.uint8)
EXPAND[TO_SAMPLE.view(np.uint8)] = np.arange(256)


def payload(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_media(payloads: list[bytes]) -> list[bytes]:
    return flac.encode([TO_SAMPLE[np.frombuffer(p, np.uint8)] for p in payloads], EXPAND.tobytes())


def from_media(media: list[bytes]) -> list[bytes]:
    """Payloads of streams, all checksums verified."""
    streams = [flac.Stream.open(m) for m in media]
    return [np.frombuffer(s.table, np.uint8)[samples.astype(np.int8).view(np.uint8)].tobytes() for s, samples in zip(streams, flac.decode(streams), strict=True)]


def _some(values: list[bytes]) -> Iterator[list[bytes]]:
    """The values in parts of about BYTES."""
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v)
        if size >= BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in _some([payload(x) for x in batch.column(1).to_pylist()]):
            rows = batch.slice(at, len(part))
            at += len(part)
            yield pa.record_batch([rows.column(0), rows.column(2), pa.array(to_media(part), pa.binary())], names=["key", "n_bytes", "media"])


def store(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored table: key, n_bytes (of the text), media."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"))
    schema = T.StructType([T.StructField("key", documents.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return written(rows.mapInArrow(_encode, schema), "media")


def feature(data: bytes) -> str:
    """Loudness and roughness of each of SEGMENTS equal parts, as two hexadecimal digits each."""
    samples = TO_SAMPLE[np.frombuffer(data, np.uint8)].astype(np.int64)
    parts = samples.reshape(SEGMENTS, -1)
    loud = np.sqrt((parts * parts).mean(axis=1))
    rough = np.abs(np.diff(parts, axis=1)).mean(axis=1)
    return "".join(f"{min(255, int(2 * a)):02x}{min(255, int(2 * b)):02x}" for a, b in zip(loud, rough, strict=True))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in _some(batch.column(2).to_pylist()):
            rows = batch.slice(at, len(part))
            at += len(part)
            back = from_media(part)
            columns = [
                pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                pa.array([len(m) for m in part], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in part]), pa.array([feature(p) for p in back]),
            ]
            yield pa.record_batch([rows.column(0), rows.column(1), *columns], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def derive(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per stored stream: digests of the payload that its decoding gives, and features."""
    longs, strings = T.LongType(), T.StringType()
    kinds = [(key, stored.schema["key"].dataType), ("n_bytes", longs), ("payload_bytes", longs), ("payload_sha256", strings), ("tail_crc32", longs), ("media_bytes", longs), ("media_sha256", strings), ("feature", strings)]
    return stored.select("key", "n_bytes", "media").mapInArrow(_derive, T.StructType([T.StructField(n, k) for n, k in kinds]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stream = flac.Stream.open(media)
            (samples,) = flac.decode([stream])
            width = 1 if stream.bits <= 8 else 2 if stream.bits <= 16 else 4
            starts = list(range(0, len(samples), stream.block))
            pcm = [samples[i : i + stream.block].astype(f"<i{width}").tobytes() for i in starts]
            yield pa.record_batch([pa.array([key] * len(starts), batch.column(0).type), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(p) // width for p in pcm], pa.int32()), pa.array(pcm, pa.binary())], names=["key", "block", "sample_offset", "samples", "pcm"])


def pcm_blocks(stored: DataFrame, key: str = "key", media: str = "media") -> DataFrame:
    """A row per block of each stream: its number, the offset of its first sample, its samples and little-endian PCM."""
    kinds = [(key, stored.schema[key].dataType), ("block", T.IntegerType()), ("sample_offset", T.LongType()), ("samples", T.IntegerType()), ("pcm", T.BinaryType())]
    return stored.where(F.col(media).isNotNull()).select(F.col(key), F.col(media)).mapInArrow(_blocks, T.StructType([T.StructField(n, k) for n, k in kinds]))
