"""The near-duplicate stage against brute force: a link is a Jaccard similarity of 0.8 over distinct five-word shingles."""

import random

import numpy as np

from loomdoc.llm import simhash


def edited(rng, words, kind, share):
    n = max(1, int(len(words) * share))
    if kind == "cut":
        return words[:-n]
    if kind == "append":
        return words + [f"more{rng.random()}" for _ in range(n)]
    out = list(words)
    for i in rng.sample(range(len(words)), max(1, n // 5)):
        out[i] = f"new{rng.random()}"
    return out


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_cut_and_appended_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    texts = []
    for i in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 40, 120, 400]))]
        kind = ("cut", "append", "replace")[i % 3]
        texts += [" ".join(words), " ".join(edited(rng, words, kind, rng.choice([0.1, 0.15, 0.18, 0.22, 0.24, 0.26, 0.3, 0.35])))]
    hub = [f"h{i}" for i in range(200)]
    texts += [" ".join(edited(rng, hub, "replace", 0.05)) for _ in range(60)]  # one dense group
    sets = [shingles(t) for t in texts]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if similar(a, b)]
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert 150 < len(pairs)
    kept = simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {r for i, r in enumerate(root) if r == i}


def test_all_pairs_across_components_meet_in_small_blocks(monkeypatch, spark):
    """A bucket of many blocks joins what any near and similar pair of it joins; what leaves it is a forest."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 3, 100)
    wide = rng.integers(0, 1 << 62, (3, 4), dtype=np.uint64)[kind] ^ (np.uint64(1) << rng.integers(0, 60, (100, 4)).astype(np.uint64))
    base = [rng.integers(0, 1 << 60, 40).tolist() for _ in range(3)]
    sets = [set(rng.choice(base[k], 36, replace=False).tolist()) | set(rng.integers(0, 1 << 60, i % 4).tolist()) for i, k in enumerate(kind)]
    points = spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(wide)], "id long, wide binary")
    held = spark.createDataFrame([(i, bytearray(np.array(sorted(x), "<u8").tobytes())) for i, x in enumerate(sets)], "id long, set binary")
    members = spark.createDataFrame([(7, i) for i in range(100)] + [(8, 5)], "bucket long, id long")
    roots = spark.createDataFrame([(i, i % 10) for i in range(10, 60)], "v long, root long")
    root = [i % 10 if i < 60 else i for i in range(100)]
    distance = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2)
    near = {(a, b) for a in range(100) for b in range(100) if root[a] != root[b] and distance[a, b] <= 8 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    found = [(r["a"], r["b"]) for r in simhash._bucket_links(members, points, held, roots, 8).collect()]
    assert len(near) > 60, len(near)
    assert set(found) <= near and len(found) < len(near), (len(found), len(near))

    def joined(pairs):
        up = list(root)
        for _ in range(100):
            for a, b in pairs:
                least = min(up[a], up[b])
                was = {up[a], up[b]}
                up = [least if x in was else x for x in up]
        return up

    assert joined(found) == joined(near)
