"""Unseen identifiers of many shapes after sure patterns; the graph's scores against a dictionary version; fillers."""

import hashlib
import math
import random
from collections import defaultdict

from loomdoc.llm import pii

UNSEEN = ["jane-doe", "jsmith", "k7", "00:1a:2b:3c:4d:5e", "DE89 3704 0044 0532 0130 00", "123 45 6789", "(555) 123-4567", "2001:db8::ff00:42:8329"]


def spans_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = pii.personal_data(rows).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "found"] for r in found}


def test_any_shape_after_a_sure_pattern(spark):
    known = [f"Please reach him under account id u{i}@mail.example.org today." for i in range(120)]
    doubtful = [f"he said that it was {x} and left" for x in ("mine", "a fox", "late", "b@c.de", "d@e.fg", "h@i.jk", "old", "bad", "7 days", "so")]
    unseen = [f"Please reach him under account id {x} today, ({x})." for x in UNSEEN]
    got = spans_of(spark, [*known, *doubtful, *unseen])
    for i, x in enumerate(UNSEEN):
        assert got[130 + i] == [x], (x, got[130 + i])
    assert all(not got[i] for i in range(130))


def test_fillers_end_before_punctuation():
    for text, want in (("x y.", "x"), ("12 34, 5", "12 34"), ("(555) 123-4567).", "(555) 123-4567"), ("a-b!?", "a-b"), ("(a)", "(a)"), ("a)", "a"), (").", ""), ("", ""), ("n 5", "n"), ("9 1 2 3 4 5 6", "9 1 2 3 4 5 6")):
        assert text[: pii.filler(text, 0)] == want, text
    assert pii.filler(")" * 200_000, 0) == 0  # linear
    assert [pii.shape(x) for x in ("Ab-cd12", "ABC", "éa 99.9", "00:1a")] == ["Aa-a9", "A", "a 9.9", "9:9a"]


def plain_scores(edges, totals, rounds, smooth, weight):
    """The same scores with dictionaries."""
    score = {e: float(e[4]) for e in edges}
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for _ in range(rounds):
        prior = sum(e[3] * score[e] for e in edges) / sum(e[3] for e in edges)
        mass, by_shape, n_shape, places = defaultdict(float), defaultdict(float), defaultdict(int), defaultdict(list)
        for e in edges:
            mass[e[0]] += e[3] * score[e]
            by_shape[e[2]] += e[3] * score[e]
            n_shape[e[2]] += e[3]
        sure = {p: m / (max(totals[p], m) + smooth) for p, m in mass.items()}
        for e in edges:
            if not e[4]:
                places[e[1], e[2]].append((e[3], sure[e[0]]))
        likely = {}
        for (i, form), held in places.items():
            pure = sum(n * c for n, c in held) / sum(n for n, _ in held)
            typical = (by_shape[form] + smooth * prior) / (n_shape[form] + smooth)
            likely[i, form] = 1 / (1 + math.exp(-(logit(pure) + weight * (logit(typical) - logit(prior)))))
        score = {e: 1.0 if e[4] else likely.get((e[1], e[2]), 0.0) for e in edges}
    return sure, likely


def test_scores_against_dictionaries(spark):
    rng = random.Random(8)
    edges = {}
    for _ in range(400):
        i = rng.randrange(120)
        edges[rng.randrange(15), i, i % 7, i % 3 == 0] = rng.randrange(1, 6)
    edges = [(p, i, form, n, seed) for (p, i, form, seed), n in edges.items()]
    totals = {p: sum(e[3] for e in edges if e[0] == p) + rng.randrange(4) for p in {e[0] for e in edges}}
    patterns, instances = pii.confident(spark.createDataFrame(edges, "pattern long, instance long, shape long, n long, seed boolean"), spark.createDataFrame(list(totals.items()), "pattern long, total long"))
    sure, likely = plain_scores(edges, totals, 3, 2.0, 0.5)
    got = {r["pattern"]: r["confidence"] for r in patterns.collect()}
    assert got.keys() == sure.keys() and all(math.isclose(got[p], sure[p], rel_tol=1e-9) for p in sure)
    got = {(r["instance"], r["shape"]): r["score"] for r in instances.collect()}
    assert got.keys() == likely.keys() and all(math.isclose(got[x], likely[x], rel_tol=1e-9) for x in likely)


def test_no_seed_no_pattern(spark):
    token = hashlib.sha1(b"x").hexdigest()
    assert spans_of(spark, ["", "a b c", f"once {token}"]) == {0: [], 1: [], 2: []}
