"""Toxicity: a linear classifier whose loss also penalises score changes when identity terms are swapped.

Features are the words of a text and their first four and five characters, present or not. Spark counts in how many
toxic and other labelled texts each one stands; those that tell the classes apart best make a vocabulary of bounded
size. A bounded sample of labelled rows (the keys whose hash is under the threshold that leaves `max_rows` of them in
expectation) gives the sparse rows of the fit. For each of these with identity terms, copies with the terms replaced by others are made, and the squared
change of the logit is part of the loss, so that a mention of a group by itself moves no score.

Defined results: null and empty texts score as a text without features; rows without a label, with a null label or a
null key are scored but not learned from; a key that is labelled twice counts twice; with no labelled rows, or only
one class, every score is the share of that class (0 with none). Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomdoc.llm.common import OWN, text_or_empty, words_of, written

#: Identity terms, by what they name; a term is swapped for others of its own line.
IDENTITY = [
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian african european american latino arab",
    "women men girls boys",
    "woman man girl boy",
    "gay straight lesbian bisexual transgender heterosexual",
    "immigrant native foreign refugee",
    "old young disabled deaf blind",
]
_GROUPS = [x.encode().split() for x in IDENTITY]
_SWAPS = {w: [v for v in g if v != w] for g in _GROUPS for w in g}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float


def features(words: list[bytes]) -> set[bytes]:
    """Words, and their prefixes of four and five characters marked by an asterisk."""
    out = set(words)
    for word in list(out):
        if len(word) > 4:
            letters = word.decode("utf-8", "replace")
            if len(letters) > 4:
                out.add(letters[:4].encode() + b"*")
            if len(letters) > 5:
                out.add(letters[:5].encode() + b"*")
    return out


def swapped(words: list[bytes], shift: int) -> list[bytes]:
    """The words with every identity term replaced by the one `shift` further in its group."""
    return [_SWAPS[w][shift % len(_SWAPS[w])] if w in _SWAPS else w for w in words]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by class; one partial count per batch of rows."""
    for batch in batches:
        counts: dict[bytes, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in features(words_of(text)):
                counts.setdefault(f, [0, 0])[label] += 1
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["feature", "n0", "n1"])


def _rows(vocabulary: dict[bytes, int], copies: int):
    """Sparse rows over the vocabulary: the text's own, then its swapped copies where it has identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, own, others = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                pick = lambda w: sorted(vocabulary[f] for f in features(w) if f in vocabulary)
                labels.append(label)
                own.append(pick(words))
                others.append([pick(swapped(words, k)) for k in range(copies)] if any(w in _SWAPS for w in words) else [])
            yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.int32()))), batch.column(2)], names=["label", "own", "others", "hash"])

    return run


def fit(labelled: DataFrame, text: str, label: str, max_features: int = 600, copies: int = 3, ridge: float = 0.02, fairness: float = 1.0) -> Model:
    """A model from all rows of `labelled`, of which `max_features` numbers a row reach the driver at most."""
    sample = labelled.where(F.col(label).isin(0, 1)).select(text_or_empty(text).alias("text"), F.col(label).cast("int").alias("label"))
    # rows are dealt one by one, as copies of a text would share its hash; the written order is what a retry deals again
    sample = written(sample.withColumn("hash", F.xxhash64("text")), "toxicity-sample")
    dealt = sample.repartition(int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, 30.0 if n1 else -30.0)
    a, b = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    counted = dealt.mapInArrow(_count, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counted.where(F.col("n0") + F.col("n1") >= 3).orderBy((F.abs(F.log(a / b)) * F.abs(a - b)).desc(), "feature").limit(max_features).select("feature").collect()
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([bytes(r["feature"]) for r in best] + list(_SWAPS)))}
    rows = dealt.mapInArrow(_rows(vocabulary, copies), "label int, own array<int>, others array<array<int>>, hash long").toPandas()
    # the same order in every run, for the same sums
    table = rows.sort_values(["hash", "label"], kind="stable", ignore_index=True)
    return _solve(table, vocabulary, ridge, fairness)


def _dense(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, row in enumerate(rows):
        out[i, np.asarray(row, np.int64)] = 1
    return out


def _solve(table: pd.DataFrame, vocabulary: dict[bytes, int], ridge: float, fairness: float, steps: int = 400) -> Model:
    """Gradient descent with momentum on logistic loss, ridge and the squared logit change of swapped copies."""
    x, y = _dense(table["own"], len(vocabulary)), table["label"].to_numpy(np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    pairs = [(i, list(other)) for i, others in enumerate(table["others"]) for other in others]
    change = x[[i for i, _ in pairs]] - _dense([o for _, o in pairs], len(vocabulary)) if pairs else None
    w, bias = np.zeros(len(vocabulary), np.float32), 0.0
    speed, speed_b = np.zeros_like(w), 0.0
    rate = 1.0
    # the penalty is quadratic, and large where many texts have identity terms: an implicit step for it can't diverge
    penalty = 2 * fairness * (change.T @ change) / len(change) if change is not None else None
    damped = np.linalg.inv(np.eye(len(w)) + rate * penalty).astype(np.float32) if penalty is not None else None
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y)
        slope = x.T @ error + ridge * w / 100
        if penalty is not None:
            slope = damped @ (slope + penalty @ w)
        speed, speed_b = 0.9 * speed - rate * slope, 0.9 * speed_b - rate * float(error.sum())
        w, bias = w + speed, bias + speed_b
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i]}, float(bias))


def score_text(model: Model, text: str | None) -> float:
    total = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(features(words_of(text)) & model.weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def scorer(model: Model):
    """A column function: text to score (0 to 1)."""

    @pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_text(model, x) for x in texts], dtype="float64")

    return score


def held_out(key: str | Column) -> Column:
    """Whether crc32 of the key as text is divisible by 5: the fold that is never learned from."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, **options) -> Model:
    """Fit on the labelled documents outside the held-out fold, at most about `max_rows` of them (the bound of the broadcast too)."""
    known = labels.select(F.col(key).alias(OWN + "key"), F.col(label).cast("int").alias(OWN + "label")).where(F.col(OWN + "label").isNotNull() & ~held_out(OWN + "key"))
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(OWN + "key"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = documents.select(F.col(key).alias(OWN + "key"), F.col(text).alias(OWN + "text")).join(F.broadcast(known), OWN + "key")
    return fit(rows, OWN + "text", OWN + "label", **options)


def toxicity(documents: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """`documents` with a score column."""
    return documents.withColumn(score, scorer(model)(F.col(text)))


__all__ = ["Model", "features", "fit", "held_out", "score_text", "scorer", "swapped", "toxicity", "train"]
