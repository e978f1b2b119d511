"""op9's fit against Newton's method; op10's pieces and bins against plain loops."""

import zlib

import numpy as np
import pandas as pd
import pytest

from loomdoc.llm import packing, toxicity
from loomdoc.llm.tokens import vocabulary_file


def newton(x, y, change, ridge, fairness):
    """The minimum of class-balanced logistic loss, ridge and counterfactual penalty."""
    n = x.shape[1]
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    fixed = np.zeros((n + 1, n + 1))
    fixed[:n, :n] = np.eye(n) * ridge / 100 + (2 * fairness * change.T @ change / len(change) if len(change) else 0)
    w = np.zeros(n + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ w))
        slope = x1.T @ (weight * (p - y)) + fixed @ w
        w -= np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + fixed + 1e-12 * np.eye(n + 1), slope)
    return 1 / (1 + np.exp(-x1 @ w))


@pytest.mark.parametrize("fairness", [0.0, 1.0, 50.0])
def test_the_fit_is_the_minimum(fairness):
    rng = np.random.default_rng(4)
    vocabulary = {f"w{i}".encode(): i for i in range(9)}
    own = [sorted(rng.choice(9, rng.integers(0, 6), replace=False).tolist()) for _ in range(120)]
    label = np.array([int(rng.random() < (0.8 if 0 in r or 8 in r else 0.2)) for r in own])
    # the last three features are identity terms, swapped in turn
    others = [[sorted({6 + (i - 5) % 3 if i > 5 else i for i in r})] if any(i > 5 for i in r) else [] for r in own]
    model = toxicity._solve(pd.DataFrame({"own": own, "label": label, "others": others}), vocabulary, 5.0, fairness)
    x = toxicity._dense(own, 9).astype(float)
    change = np.array([a - b for a, o in zip(x, [toxicity._dense(o, 9) for o in others], strict=True) for b in o]).reshape(-1, 9)
    want = newton(x, label, change, 5.0, fairness)
    got = [toxicity.score_text(model, " ".join(f"w{i}" for i in r)) for r in own]
    assert np.abs(np.array(got) - want).max() < 2e-3
    if fairness == 50:
        assert max(abs(model.weights.get(f"w{a}".encode(), 0) - model.weights.get(f"w{b}".encode(), 0)) for a in (6, 7, 8) for b in (6, 7, 8)) < 0.1


def test_a_text_repeated_in_the_sample_is_dealt_out(spark):
    rows = [("you idiot fool", 1)] * 3000 + [("a kind day out", 0)] * 300 + [(f"you idiot {i}", 1) for i in range(40)] + [(f"kind day {i}", 0) for i in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), "text", "label")
    assert toxicity.score_text(model, "you idiot") > 0.5 > toxicity.score_text(model, "a kind day")


def plain_best_fit(lengths, capacities, weights):
    """Bins as lists, each piece by a loop over all of them."""
    bins, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for k, (left, _) in enumerate(bins):
            if all(a >= b for a, b in zip(left, need, strict=True)):
                norm = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, need, capacities, strict=True))
                if best is None or norm < best[0] - 1e-12:
                    best = (norm, k)
        if best is None:
            bins.append([list(capacities), []])
            best = (0, len(bins) - 1)
        left, held = bins[best[1]]
        place[i] = (best[1], int(capacities[0] - left[0]))
        bins[best[1]][0] = [a - b for a, b in zip(left, need, strict=True)]
        held.append(i)
    return bins, place


@pytest.mark.parametrize("capacities", [(2048, 2048, 2048**2), (2048, 5, 2048**2), (2048, 40, 1_500_000), (100, 4, 6000)])
def test_vector_best_fit_is_the_plain_one(capacities):
    rng = np.random.default_rng(capacities[1])
    most = int(min(capacities[0], capacities[2] ** 0.5))
    lengths = rng.integers(1, most, 300)
    bins, _ = plain_best_fit(lengths.tolist(), capacities, (1.0, 0.05, 0.05))
    sequence, offset = packing.best_fit(lengths, capacities)
    # ties between bins of equal residuals may fall differently: what the bins hold is the same
    held = lambda groups: sorted(sorted(lengths[g].tolist()) for g in groups)
    assert held([np.flatnonzero(sequence == s) for s in np.unique(sequence)]) == held([b for _, b in bins])
    for s in np.unique(sequence):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
        ends = np.cumsum([0, *[n for _, n in own]])
        assert [o for o, _ in own] == ends[:-1].tolist() and ends[-1] <= capacities[0]
        assert len(own) <= capacities[1] and sum(int(n) ** 2 for _, n in own) <= capacities[2]


def test_binding_capacities_over_a_table(spark):
    """Document counts and attention costs that bind: no sequence exceeds one, and no piece is lost."""
    docs = spark.createDataFrame([(i, " ".join(["word"] * (1 + i * 37 % 300))) for i in range(400)], "doc_id long, text string")
    file = vocabulary_file("byte_bpe_50k.json")
    packed = packing.pack(docs, file, 0, max_tokens=512, max_documents=4, max_attention=120_000.0, with_ids=False).toPandas()
    per = packed.assign(cost=packed["length"].astype("int64") ** 2).groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"), cost=("cost", "sum"))
    assert per["n"].max() <= 4 and per["tokens"].max() <= 512 and per["cost"].max() <= 120_000
    assert packed["doc_id"].nunique() == 400
    bound = packing.pack(docs, file, 0, max_tokens=512, with_ids=False).toPandas()
    assert bound["sequence_id"].nunique() < len(per)


def test_pieces_start_and_crc_by_the_tokenizer(spark):
    from tokenizers import Tokenizer

    file = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    texts = [(1, None), (2, ""), (3, "a b c"), (4, "Häuser und Bäume. " * 900), (4, "Häuser und Bäume. " * 900), (None, "x " * 5000), (6, "y" * 3000)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), file, 0, with_ids=False).collect()
    want = []
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first, start, piece = len(ids) % 2048 or min(2048, len(ids)), 0, 0
        while start < len(ids):
            n = first if piece == 0 else 2048
            want.append((key, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start, piece = start + n, piece + 1
    row = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(row, got), key=repr) == sorted(want, key=repr)


def test_equal_rows_are_dealt_over_groups(spark):
    docs = spark.createDataFrame([(1, "same text here")] * 3000, "doc_id long, text string")
    packed = packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), 0, group=500, with_ids=False)
    groups = [r["count"] for r in packed.groupBy((packed["sequence_id"] / (1 << 32)).cast("int")).count().collect()]
    assert sum(groups) == 3000 and max(groups) < 800
