"""The inverted file: exact search by it is brute force, its approximation has the recall that it was calibrated to."""

import numpy as np
import pytest

from loomdoc.operators import ann, search

SCHEMA = "vec_id long, embedding array<float>, cell int, name string, distance double"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * 0.4).astype(np.float32).tolist()) for i in range(900)]
    hot = rows[5][1]
    return rows + [(2000 + i, hot) for i in range(400)] + [(5, hot), (5, hot), (3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [1.0] * 7)]


@pytest.fixture(scope="module")
def chunks(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", 0.5) for i, v in vectors], SCHEMA).repartition(4).cache()


def brute(vectors, queries, k):
    known = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in vectors if v and len(v) == 24 and np.isfinite(v).all() and any(v)]
    ids, rows = np.array([i for i, _ in known]), np.stack([x for _, x in known])
    out = []
    for q, v in queries:
        if v and len(v) == 24 and np.isfinite(v).all() and any(v):
            d = np.round(((rows - np.array(v, float) / np.linalg.norm(v)) ** 2).sum(1), search.DIGITS)
            order = np.lexsort((ids, d))[:k]
            out += [(q, int(ids[j]), round(float(d[j]), 6), n + 1) for n, j in enumerate(order)]
    return sorted(out)


@pytest.fixture(scope="module")
def index(chunks):
    return ann.build(chunks, ann.fit(chunks, cells=16))


def rows_of(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["distance"], 6), r["rank"]) for r in df.collect())


def asked(chunks):
    return chunks.where("vec_id % 20 = 0 or vec_id >= 2990")


def test_pruned_search_is_brute_force(chunks, vectors, index, monkeypatch):
    queries = [(i, v) for i, v in vectors if i % 20 == 0 or i >= 2990]
    expected = brute(vectors, queries, 5)
    assert rows_of(ann.nearest_exactly(index, asked(chunks))) == expected
    monkeypatch.setattr(ann, "BLOCK", 32)  # many blocks of rows and queries in a cell
    assert rows_of(ann.nearest_exactly(index, asked(chunks))) == expected
    assert rows_of(ann.nearest_exactly(index, asked(chunks), k=2000)) == brute(vectors, queries, 2000)


def test_approximate_search(chunks, vectors, index):
    tuned = ann.calibrated(index)
    assert 1 <= tuned.probes < 16  # clusters lie apart, so that few cells have the neighbours
    found = ann.nearest(tuned, asked(chunks))
    true = brute(vectors, [(i, v) for i, v in vectors if i % 20 == 0], 5)
    got = {r[:2] for r in rows_of(found)}
    assert len(got & {r[:2] for r in true}) >= 0.9 * len({r[:2] for r in true})
    # what was found has its exact distance, and ties of the hot vector go to the smallest keys
    exact = {r[:2]: r[2] for r in brute(vectors, [(i, v) for i, v in vectors if i % 20 == 0], 2000)}
    assert all(exact[r[:2]] == r[2] for r in rows_of(found))
    assert ann.recall_of(found, search.top_k_batch(chunks.where("vec_id % 20 = 0 and size(embedding) = 24"), chunks.where("size(embedding) = 24"))).first()["recall"] >= 0.9
    # probing all cells with every row as a candidate is exact
    assert rows_of(ann.nearest(index, asked(chunks), probes=16, refine=2000)) == true + [r for r in brute(vectors, [(i, v) for i, v in vectors if i >= 2990], 5)]


def test_probes_prune_partitions(chunks, index):
    plan = ann.nearest(index, chunks.where("vec_id = 40"), probes=1)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert "code" in plan


def test_codes_stand_for_residuals(vectors):
    rows = np.stack([np.array(v) / np.linalg.norm(v) for _, v in vectors[:900]])
    model = ann.Model.fit(rows, 16)
    cell, code, radius = model.encode(rows)
    near = ann._squares(rows, model.centres)
    assert (near.argmin(1) == cell).all() and np.allclose(radius, np.sqrt(near.min(1)))
    tables = np.stack([model.tables(r[None], c)[0] for r, c in zip(rows, cell, strict=True)])
    approximate = np.array([sum(t[i, c] for i, c in enumerate(code_)) for t, code_ in zip(tables, code, strict=True)])
    assert approximate.max() < 0.05  # a row is close to its own code


def test_empty_tables(spark, chunks, index):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.fit(none) is None
    assert ann.nearest(index, none).count() == 0 and ann.nearest_exactly(index, none).count() == 0
    empty = ann.build(none, index.model)
    assert ann.nearest(ann.calibrated(empty), asked(chunks)).count() == 0
    assert ann.nearest_exactly(empty, asked(chunks)).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(index, chunks, k=0)


def test_routes_are_made_in_bounded_batches():
    """512 queries with all cells were one batch, with a vector for each pair."""
    import numpy as np
    import pyarrow as pa

    from loomdoc.operators import ann

    rng = np.random.default_rng(1)
    model = ann.Model(rng.normal(size=(3000, 8)), [])
    queries = rng.normal(size=(20, 8))
    batch = pa.record_batch([pa.array(range(20)), pa.array(list(queries), pa.list_(pa.float64()))], names=["name", "vector"])
    made = list(ann._routes(batch, model, 3000))
    assert max(b.num_rows for b in made) <= ann.ROUTED and sum(b.num_rows for b in made) == 20 * 3000
    nearest = [b.to_pandas().groupby("name")["cell"].first() for b in made]
    want = ((queries[:, None] - model.centres[None]) ** 2).sum(2).argmin(1)
    assert [int(c) for s in nearest for c in s] == [int(c) for c in want]
