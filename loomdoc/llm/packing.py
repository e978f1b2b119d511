"""Best-fit packing: documents into sequences under token, document-count and attention-cost capacities.

Documents are encoded and an end id is added; only longer ones than a sequence are cut, into full pieces from the
end, so that the first piece may be shorter. A full piece is a sequence by itself. The others go, dealt by a hash of
their document, number and row (a row number written with the pieces, which tells copies apart) into groups of about `group` pieces, to vector best-fit: pieces in falling order of
length; each goes to the open sequence which has room for it in every dimension and the smallest weighted residual
norm after it, or to a new one. A group is bounded, so no task holds more than that many pieces; a group ends with
at most a few sequences that others could have filled, one in thousands.

The attention cost of a sequence is the sum of its pieces' squared lengths, as pieces don't attend to each other.
The default capacities are those that no full sequence exceeds, so tokens decide.

Defined results: null and empty texts are an end id only; repeated rows are packed as often as they come; null keys
stay null; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.llm.common import OWN, text_or_empty, written
from loomdoc.llm.tokens import encoder

ROWS = 512  # texts that are encoded at a time


def cut(n: int, capacity: int) -> list[int]:
    """The lengths of a document's pieces: full ones, after a first one with the rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def _pieces(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, 4)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows: list[tuple] = []
                for key, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    start = 0
                    for i, n in enumerate(cut(len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + n)]
                        rows.append((key, i, start, n, zlib.crc32(piece), piece if with_ids else None))
                        start += n
                columns = list(zip(*rows, strict=True))
                types = [part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["key", "piece", "start", "length", "crc", "ids"])

    return run


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece.

    The residual of a sequence is a vector (tokens, documents, attention cost) in shares of the capacities. Of the open
    sequences with room in every dimension, the one with the smallest weighted norm of the residual that is left wins;
    ties go to the oldest. A sequence without room for another token or document is closed.
    """
    capacity = np.asarray(capacities, np.float64)
    weight = np.asarray(weights, np.float64)
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    residual = np.zeros((n, 3))
    number = np.zeros(n, np.int64)  # of the open sequences
    count = bins = 0
    shortest = float(lengths.min()) if n else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = residual[:count] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            norm = ((left[fits] / capacity) ** 2) @ weight
            at = fits[int(np.argmin(norm))]
            offset[i] = int(capacity[0] - residual[at, 0])
            residual[at] = left[at]
        else:
            if (need > capacity).any():
                raise ValueError(f"a piece of {lengths[i]} tokens exceeds a capacity")
            at = count
            residual[at], number[at] = capacity - need, bins
            count, bins = count + 1, bins + 1
        bin_of[i] = number[at]
        if residual[at, 0] < shortest or residual[at, 1] < 1:
            count -= 1
            residual[at], number[at] = residual[count], number[count]
    return bin_of, offset


def pack(documents: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", max_tokens: int = 2048, max_documents: int | None = None, max_attention: float | None = None, group: int = 6000, with_ids: bool = True) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    max_documents = max_documents or max_tokens
    max_attention = max_attention or float(max_tokens) ** 2
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).cast("string").alias("key"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("ids", T.BinaryType())])
    encoded = rows.mapInArrow(_pieces(vocabulary, end_id, max_tokens, with_ids), schema)
    # written before it is read, so that a retry deals the same
    pieces = written(encoded.withColumn(OWN + "row", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, -(-pieces.count() // group))
    deal = pieces.select("*", F.pmod(F.xxhash64("key", "piece", "crc", OWN + "row"), F.lit(groups)).alias(OWN + "group"))
    capacities = (float(max_tokens), float(max_documents), float(max_attention))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "piece", "crc", OWN + "row"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        sequence, offset = best_fit(rows["length"].to_numpy(np.int64), capacities)
        return pd.DataFrame({**{c: rows[c] for c in ("key", "piece", "start", "length", "crc", "ids")}, "sequence_id": (int(rows[OWN + "group"].iloc[0]) << 32 if len(rows) else 0) + sequence, "offset": offset})

    packed = deal.groupBy(OWN + "group").applyInPandas(fit, T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    out = [F.col("key").cast(kind).alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return packed.select(*out)
