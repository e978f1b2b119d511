"""Approximate nearest neighbours by an inverted file: k-means cells, product-quantised residuals, exact re-ranking.

The model is fitted on a bounded sample: at most about SAMPLE distinct unit vectors, drawn by a hash of the key, from which
k-means makes the cells (as many as the root of the number of rows, CELLS at most) and, for every PART dimensions of the
residuals to the cells' centres, a book of 256 words. Every row is indexed, in the cell of its nearest centre, with one byte
per book. The index is a table partitioned by cell; its codes are read without its vectors, and Spark prunes the partitions
of cells that no query probes.

`nearest` looks a query up in its `probes` nearest cells: the codes give candidates by sums of table entries, of which the
best `refine * k` meet their vectors and are ranked by exact distance. `calibrated` finds how many probes a wanted recall
takes, from where the true neighbours of a bounded sample of rows lie. `nearest_exactly` gives the rows of an exact search: a
first look gives each query a distance that its k-th neighbour can't exceed, and by the triangle inequality only cells whose
ball (centre and measured radius) comes within that distance are scanned, by exact distances.

Cells are scanned in blocks of BLOCK rows by blocks of BLOCK queries, so that a cell with a third of all rows is many tasks;
queries with the same vector are one. Ties go to the smallest key, at every step.

Defined results: rows without a valid vector, or with one of another length than the model's, aren't indexed and find
nothing; repeated rows are neighbours of their own; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import vector as v
from loomdoc.operators.search import DIGITS, check_top_k, first_k
from loomdoc.session import scratch

SAMPLE, CELLS, PART, WORDS, ROUNDS = 1 << 15, 4096, 4, 256, 12
BLOCK, ROUTED = 4096, 1 << 13
TRIED = 128  # rows that a recall is estimated from


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None])


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = 1 + (1 << 24) // max(1, len(centres))
    return np.concatenate([_squares(rows[at : at + step], centres).argmin(1) for at in range(0, len(rows), step)]) if len(rows) else np.zeros(0, np.int64)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centres of the rows; a centre without rows stays where it is."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = _closest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(1, counts), centres)
    return centres


@dataclass(frozen=True)
class Model:
    """Centres of the cells and, for each PART dimensions of a residual, a book of words."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> Model:
        centres = k_means(sample, cells)
        rest = sample - centres[_closest(sample, centres)]
        return cls(centres, [k_means(rest[:, at : at + PART], WORDS) for at in range(0, sample.shape[1], PART)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and distance to the centre of each row."""
        cell = _closest(rows, self.centres)
        rest = rows - self.centres[cell]
        code = np.stack([_closest(rest[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)
        return cell, code, np.sqrt((rest * rest).sum(1))

    def tables(self, rows: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the parts of each row's residual to all words: rows x books x words."""
        rest = rows - self.centres[cell]
        return np.stack([np.pad(_squares(rest[:, i * PART : (i + 1) * PART], book), ((0, 0), (0, WORDS - len(book)))) for i, book in enumerate(self.books)], axis=1)


@dataclass(frozen=True)
class Index:
    """The rows (cell, at, id, code, vector as it came) partitioned by cell, and what is known of each cell (a row per cell: CELLS at most)."""

    model: Model
    rows: DataFrame
    cells: DataFrame
    probes: int


def _units(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    return rows.where(v.valid(F.col(embedding))).select(F.col(key).alias("id"), v.unit(F.col(embedding)).alias("vector"))


def fit(chunks: DataFrame, key: str = "vec_id", embedding: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Model | None:
    """A model of the chunks' vectors from about `sample` rows at most; None without any valid one."""
    rows = _units(chunks, key, embedding)
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    drawn = rows if share == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = drawn.select("vector").distinct().collect()  # `sample` rows, in expectation
    if not found:
        return None
    size = max(set(lengths := [len(r["vector"]) for r in found]), key=lengths.count)
    vectors = np.array(sorted(r["vector"] for r in found if len(r["vector"]) == size))
    return Model.fit(vectors, cells or int(np.clip(np.ceil(np.sqrt(n)), 1, CELLS)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def build(chunks: DataFrame, model: Model, key: str = "vec_id", embedding: str = "embedding", path: str | None = None) -> Index:
    """Index every chunk below `path`, by default a new folder of the shared one."""
    spark = chunks.sparkSession
    path = path or scratch(spark, "ann")
    valid = chunks.where(v.valid(F.col(embedding)) & (F.size(embedding) == model.dimensions))
    kept = valid.select(F.monotonically_increasing_id().alias("at"), F.col(key).alias("id"), F.col(embedding).alias("vector"), v.unit(F.col(embedding)).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, code, radius = model.encode(_matrix(batch.column(3), model.dimensions))
            yield pa.record_batch([pa.array(cell, pa.int32()), *batch.columns[:2], pa.array([c.tobytes() for c in code], pa.binary()), batch.column(2), pa.array(radius)], names=["cell", "at", "id", "code", "vector", "radius"])

    at, id_, vector, _ = kept.schema
    schema = T.StructType([T.StructField("cell", T.IntegerType()), at, id_, T.StructField("code", T.BinaryType()), vector, T.StructField("radius", T.DoubleType())])
    # rows of a cell come together, and those of a large one in as many files as its size asks for
    kept.mapInArrow(run, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    return opened(spark, path, model, schema)


def opened(spark: SparkSession, path: str, model: Model, schema: T.StructType) -> Index:
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    rows.groupBy("cell").agg(F.count("*").alias("size"), F.max("radius").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index(model, rows, spark.read.schema("cell int, size long, radius double").parquet(f"{path}/cells"), len(model.centres))


def _asked(queries: DataFrame, model: Model, key: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with a name each, and the queries by the names of theirs."""
    rows = _units(queries, key, embedding).where(F.size("vector") == model.dimensions)
    names = rows.groupBy("vector").agg(F.min("id").alias("name"))
    return names, rows.join(names, "vector").select("id", "name")


def _routes(batch: pa.RecordBatch, model: Model, most: int) -> Iterator[pa.RecordBatch]:
    """The `most` nearest cells of a batch's queries: a vector comes with each of them, so that about ROUTED rows are made at a time."""
    step = max(1, ROUTED // most)
    for begin in range(0, batch.num_rows, step):
        part = batch.slice(begin, step)
        squared = _squares(_matrix(part.column(1), model.dimensions), model.centres)
        cells = np.argsort(squared, axis=1, kind="stable")[:, :most]
        rows = pa.array(np.repeat(np.arange(part.num_rows), most))
        far = np.sqrt(np.take_along_axis(squared, cells, 1)).ravel()
        yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(cells.ravel(), pa.int32()), pa.array(far)], names=["name", "vector", "cell", "centre"])


def _routed(names: DataFrame, model: Model, probes: int | None) -> DataFrame:
    """Each query's cells (name, vector, cell, centre): the nearest ones, or all; `centre` is the distance to the cell's."""
    kind = names.schema["name"].dataType
    most = min(probes or len(model.centres), len(model.centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _routes(batch, model, most)

    fields = [T.StructField("name", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("centre", T.DoubleType())]
    return names.select("name", "vector").mapInArrow(run, T.StructType(fields))


def _scanned(index: Index, routed: DataFrame, columns: list[str], run, schema: T.StructType) -> DataFrame:
    """`run` of a block of queries and a block of rows (with `columns`) of every cell that is probed."""
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    asked = routed.groupBy("cell").agg(F.count("*").alias("queries"))
    # a row per cell, CELLS at most; the join prunes the partitions of the others
    known = F.broadcast(index.cells.join(asked, "cell").select("cell", blocks(F.col("size")).alias("n_rows"), blocks(F.col("queries")).alias("n_queries")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(known, "cell").withColumn("q", F.pmod(F.xxhash64("name"), "n_queries").cast("int")).withColumn("r", spread("n_rows"))
    right = index.rows.select("cell", "at", "id", *[v.unit(F.col(c)).alias(c) if c == "vector" else c for c in columns]).join(known, "cell").withColumn("r", F.pmod("at", "n_rows").cast("int")).withColumn("q", spread("n_queries"))
    left, right = (side.drop("n_rows", "n_queries") for side in (left, right))
    return left.groupBy("cell", "r", "q").cogroup(right.groupBy("cell", "r", "q")).applyInPandas(run, schema)


def _found(index: Index, names: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("name", names.schema["name"].dataType), T.StructField("id", index.rows.schema["id"].dataType), T.StructField("distance", T.DoubleType()), *more])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _candidates(model: Model, n: int):
    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The n best of the block for each query by the codes."""
        if queries.empty or rows.empty:
            return pd.DataFrame({"name": queries["name"][:0], "id": rows["id"][:0], "distance": np.zeros(0), "cell": np.zeros(0, np.int32), "at": np.zeros(0, np.int64)})
        rows = rows.sort_values(["id", "at"], ignore_index=True)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        number, vectors, out = int(queries["cell"].iloc[0]), np.stack(queries["vector"].to_numpy()), []
        for begin in range(0, len(vectors), 64):
            tables = model.tables(vectors[begin : begin + 64], number)
            total = np.zeros((len(tables), len(codes)))
            for i in range(codes.shape[1]):
                total += tables[:, i, codes[:, i]]
            for j, row in enumerate(total):
                best = first_k(row, n)
                out.append((np.full(len(best), begin + j), best, row[best]))
        asked, best, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"name": queries["name"].to_numpy()[asked], "id": rows["id"].to_numpy()[best], "distance": distance, "cell": np.int32(number), "at": rows["at"].to_numpy()[best]})

    return cell


def _exact(k: int):
    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of the block for each query."""
        if queries.empty or rows.empty:
            return pd.DataFrame({"name": queries["name"][:0], "id": rows["id"][:0], "distance": np.zeros(0), "cell": np.zeros(0, np.int32)})
        rows = rows.sort_values(["id", "at"], ignore_index=True)
        vectors, known, out = np.stack(queries["vector"].to_numpy()), np.stack(rows["vector"].to_numpy()), []
        for begin in range(0, len(vectors), 256):
            squared = _squares(some := vectors[begin : begin + 256], known)
            for j, row in enumerate(squared):
                near = np.flatnonzero(row <= row[first_k(row, k)].max() + 1e-9)  # exact distances only for these
                exact = np.round(((known[near] - some[j]) ** 2).sum(axis=1), DIGITS)
                best = first_k(exact, k)
                out.append((np.full(len(best), begin + j), near[best], exact[best]))
        asked, best, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"name": queries["name"].to_numpy()[asked], "id": rows["id"].to_numpy()[best], "distance": distance, "cell": rows["cell"].to_numpy()[best]})

    return cell


def _looked_up(index: Index, names: DataFrame, k: int, probes: int | None, refine: int) -> DataFrame:
    """Columns name, id, distance, rank of the approximate search."""
    schema = _found(index, names, T.StructField("cell", T.IntegerType()), T.StructField("at", T.LongType()))
    found = _scanned(index, _routed(names, index.model, probes), ["code"], _candidates(index.model, refine * k), schema)
    best = _ranked(found, refine * k).select("name", "cell", "at")
    vectors = index.rows.select("cell", "at", "id", v.unit(F.col("vector")).alias("known"))
    met = best.join(vectors, ["cell", "at"]).join(names, "name")
    return _ranked(met.select("name", "id", F.round(v.distance(F.col("known"), F.col("vector")), DIGITS).alias("distance")), k)


def _answers(found: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.withColumnRenamed("id", "query_id").join(found.withColumnRenamed("id", "chunk_id"), "name").select("query_id", "chunk_id", "distance", "rank")


def nearest(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None, refine: int = 16, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Columns query_id, chunk_id, distance, rank; without `probes` as many cells as the index was calibrated to."""
    names, asked = _asked(queries, index.model, key, embedding)
    return _answers(_looked_up(index, names, check_top_k(k), probes or index.probes, refine), asked)


def _everything(index: Index, names: DataFrame, k: int) -> DataFrame:
    """name, id, distance, cell and rank by a scan of all cells."""
    schema = _found(index, names, T.StructField("cell", T.IntegerType()))
    return _ranked(_scanned(index, _routed(names, index.model, None), ["vector"], _exact(k), schema), k)


def nearest_exactly(index: Index, queries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", first: int = 4) -> DataFrame:
    """The rows of an exact search: only cells that can hold a neighbour are scanned."""
    names, asked = _asked(queries, index.model, key, embedding)
    looked = _looked_up(index, names, check_top_k(k), first, 2).groupBy("name").agg(F.max("distance").alias("most"), F.count("*").alias("n"))
    # fewer than k so far: any cell may hold one
    limit = looked.select("name", F.when(F.col("n") >= k, F.sqrt("most")).alias("limit"))
    routed = _routed(names, index.model, None).join(F.broadcast(index.cells), "cell").join(limit, "name", "left")
    near = routed.where(F.col("limit").isNull() | (F.col("centre") - F.col("radius") <= F.col("limit") + 1e-6)).select("name", "vector", "cell", "centre")
    schema = _found(index, names, T.StructField("cell", T.IntegerType()))
    return _answers(_ranked(_scanned(index, near, ["vector"], _exact(k), schema), k), asked)


def calibrated(index: Index, k: int = 5, recall: float = 0.95, tried: int = TRIED) -> Index:
    """The index with as many probes as `recall` of the true neighbours of about `tried` of its rows take, searched in all cells."""
    n = index.cells.agg(F.sum("size")).first()[0] or 0
    share = int(min(1.0, tried / max(1, n)) * (1 << 30))
    drawn = index.rows.where(F.pmod(F.xxhash64("id", "at"), F.lit(1 << 30)) < share)
    names = drawn.select("id", v.unit(F.col("vector")).alias("vector")).groupBy("vector").agg(F.min("id").alias("name"))
    true = _everything(index, names, k).select("name", "cell")
    place = F.row_number().over(Window.partitionBy("name").orderBy("centre", "cell"))
    places = true.join(_routed(names, index.model, None).select("name", "cell", place.alias("place")), ["name", "cell"])
    counts = sorted((r["place"], r["count"]) for r in places.groupBy("place").count().collect())  # a row per cell at most
    total, so_far = sum(c for _, c in counts), 0
    for cells, c in counts:
        so_far += c
        if so_far >= recall * total:
            return replace(index, probes=cells)
    return index


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: the share of the true (query_id, chunk_id) that were found, of queries that `true` has."""
    pair = ["query_id", "chunk_id"]
    hits = true.select(*pair).join(found.select(*pair).distinct().withColumn("hit", F.lit(1)), pair, "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))
