"""Exact vector search: validation, metadata filters, top-k, cut-off after it; single queries and query sets in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.functions import vector as v

TOP_K, THRESHOLD = 5, 0.68
DIGITS = 12  # of a distance that ranks; what is behind them is noise of the sums
FILTER_FIELDS = ("article_id", "source_file", "document_id", "file_type")


def check_top_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("top_k must be a positive integer")
    return k


def where_clause(filters: dict[str, str | None] | None, fields: tuple[str, ...] = FILTER_FIELDS) -> Column:
    """All clauses at once: unknown fields are an error, empty values no clause."""
    unknown = sorted(set(filters or {}) - set(fields))
    if unknown:
        raise ValueError(f"unknown filter fields: {', '.join(unknown)}")
    out = F.lit(True)
    for field, value in (filters or {}).items():
        if value:
            out = out & (F.col(field) == value)
    return out


def top_k(chunks: DataFrame, vector: list[float], k: int = TOP_K, filters: dict | None = None, fields: tuple[str, ...] = FILTER_FIELDS, threshold: float | None = THRESHOLD, metric: str = "l2sq", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest chunks with their distance, then without those beyond the threshold (null distances stay).

    The cut-off comes after the limit, so that fewer than k rows may be left. Filters reach the scan.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    rows = chunks.where(where_clause(filters, fields)).withColumn("distance", v.distance(v.unit(F.col(embedding)), v.unit(query), metric))
    best = rows.orderBy(F.col("distance").asc_nulls_last(), key).limit(check_top_k(k))
    return best if threshold is None else best.where(F.col("distance").isNull() | (F.col("distance") <= threshold))


def first_k(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values in their order; of equal ones the first."""
    if k < len(values):
        last = np.partition(values, k - 1)[k - 1]
        some = np.flatnonzero(values <= last)
        return some[np.argsort(values[some], kind="stable")][:k]
    return np.argsort(values, kind="stable")


def _nearest(k: int):
    def cell(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        """The k nearest chunks of this cell for each of its queries; of those at the same rounded distance the smallest keys."""
        if queries.empty or chunks.empty:
            return pd.DataFrame({"query_id": queries["id"][:0], "chunk_id": chunks["id"][:0], "distance": np.zeros(0)})
        chunks = chunks.sort_values("id", ignore_index=True)
        a, b = np.stack(queries["vector"].to_numpy()), np.stack(chunks["vector"].to_numpy())
        out = []
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            near = 2 - 2 * (some @ b.T)  # unit vectors; exact distances only for what may be among the nearest
            last = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, [min(k, near.shape[1]) - 1]]
            i, j = np.nonzero(near <= last + 1e-9)
            exact = np.round(((some[i] - b[j]) ** 2).sum(axis=1), DIGITS)
            cuts = np.flatnonzero(np.diff(i, prepend=-1, append=len(some)))
            best = np.concatenate([lo + first_k(exact[lo:hi], k) for lo, hi in zip(cuts, cuts[1:], strict=False)])
            out.append(pd.DataFrame({"query_id": queries["id"].to_numpy()[at + i[best]], "chunk_id": chunks["id"].to_numpy()[j[best]], "distance": exact[best]}))
        return pd.concat(out, ignore_index=True)

    return cell


def top_k_batch(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, key: str = "vec_id", embedding: str = "embedding", block: int = 4096, query_key: str | None = None) -> DataFrame:
    """The k nearest chunks of every query: query_id, chunk_id, distance, rank, by distance (to DIGITS digits) and chunk_id.

    Queries and chunks are dealt into blocks; every pair of blocks is a cell with a bounded number of rows, which gives
    candidates for each of its queries by one matrix product; a last ranking per query joins the cells. Keys keep their type.
    Chunks without a valid vector have no distance: they come last, where there are fewer than k others.
    """
    check_top_k(k)
    rows = lambda df, name: df.where(v.valid(F.col(embedding))).select(F.col(name).alias("id"), v.unit(F.col(embedding)).alias("vector"))
    q, c = rows(queries, query_key or key), rows(chunks, key)
    sizes = q.count(), c.count()
    n_q, n_c = (max(1, -(-n // block)) for n in sizes)
    asked = q.select(F.col("id").alias("query_id"))
    q = q.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_q))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    c = c.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n_c))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    cells = q.groupBy("q", "c").cogroup(c.groupBy("q", "c"))
    kinds = [T.StructField("query_id", q.schema["id"].dataType), T.StructField("chunk_id", c.schema["id"].dataType), T.StructField("distance", T.DoubleType())]
    found = cells.applyInPandas(_nearest(k), T.StructType(kinds))
    if sizes[1] < k:
        invalid = chunks.where(~v.valid(F.col(embedding))).select(F.col(key).alias("id")).orderBy("id").limit(k - sizes[1]).collect()
        if invalid:
            last = F.explode(F.array(*[F.lit(r["id"]).cast(kinds[1].dataType) for r in invalid]))
            found = found.unionByName(asked.select("query_id", last.alias("chunk_id"), F.lit(None).cast("double").alias("distance")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic_search(questions: DataFrame, chunks: DataFrame, embedder, k: int = TOP_K, filters: dict | None = None, fields: tuple[str, ...] = FILTER_FIELDS, threshold: float | None = THRESHOLD) -> DataFrame:
    """Hits of every question: question_id, rank, distance and the chunk's columns but its embedding.

    k and filters are checked before anything is embedded. embedder: questions to the same with a column `embedding`.
    """
    check_top_k(k)
    clause = where_clause(filters, fields)
    asked = embedder(questions)
    hits = top_k_batch(asked, chunks.where(clause), k, "chunk_id", query_key="question_id").withColumnRenamed("query_id", "question_id")
    near = hits if threshold is None else hits.where(F.col("distance").isNull() | (F.col("distance") <= threshold))
    return near.join(chunks.drop("embedding"), "chunk_id")


def embed(texts: DataFrame, column: str, provider, batch: int = 32) -> DataFrame:
    """Rows with an embedding from a provider: a callable of a list of texts, called with `batch` of them at a time."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            values = series.tolist()
            if any(x is None or not x.strip() for x in values):
                raise ValueError("blank text can't be embedded")
            out: list = []
            for at in range(0, len(values), batch):
                some = values[at : at + batch]
                got = provider(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} embeddings for {len(some)} texts")
                out += [list(map(float, x)) for x in got]
            yield pd.Series(out, dtype=object)

    return texts.withColumn("embedding", run(F.col(column))).withColumn("embedding", v.unit(F.col("embedding")))
