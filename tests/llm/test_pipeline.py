"""Every stage of the pipeline against a plain version of it, each on what the one before kept."""

import hashlib
import math
import os
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomdoc.llm import pii, toxicity
from loomdoc.llm.common import table, written
from loomdoc.llm.tokens import vocabulary_file

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


def not_toxic(spark, rows):
    docs = table(spark, FOLDER, "documents")
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, FOLDER, "labels"))
    return [r for r in rows if toxicity.score_text(model, r["text"]) < 0.5]


def one_of_each_group(rows):
    def shingled(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingled(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r["doc_id"])
    return {min(g) for g in groups.values()}


def copies(rows):
    """How often each row comes: a plain inversion of the Poisson distribution."""
    n = Counter(r["source"] for r in rows)
    out = Counter()
    for r in rows:
        mean = len(rows) / len(n) / n[r["source"]]
        parts = max(1, math.ceil(mean / 16))
        for j in range(1, parts + 1):
            name = hashlib.md5((r["text"] or "").encode()).hexdigest()
            u = int(hashlib.md5(f"42:{r['doc_id']}:{name}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            k, p = 0, math.exp(-mean / parts)
            total = p
            while u >= total and k < 60:
                k += 1
                p *= mean / parts / k
                total += p
            out[r["doc_id"]] += k
    return +out


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    rows = docs.collect()

    def run(name, given):
        made = written(stages[name](spark, given, FOLDER), f"test-{name}")
        return made, made.collect()

    docs, kept = run("toxicity", docs)
    assert docs.columns == columns and sorted(kept) == sorted(not_toxic(spark, rows)) and 0 < len(kept) < len(rows)
    docs, some = run("near_duplicates", docs)
    assert docs.columns == columns and {r["doc_id"] for r in some} == one_of_each_group(kept) and len(some) < len(kept)
    docs, clean = run("personal_data", docs)
    plain = {r["doc_id"]: pii.mask(r["text"], pii.base_spans(r["text"]) + pii.secret_spans(r["text"])) for r in some}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in clean} == plain and all(r["n_chars"] == len(r["text"]) for r in clean)
    docs, mixed = run("mixing", docs)
    assert docs.columns == columns and Counter(r["doc_id"] for r in mixed) == copies(clean)
    _, packed = run("packing", docs)
    tokenizer = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    tokens = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == tokens
    held = Counter()
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048 and len(held) <= math.ceil(tokens / 2048) * 1.05 + 1
