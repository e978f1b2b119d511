"""The registered queries on the given tables: against their SQL, against brute force, or by held-out accuracy."""

import hashlib
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomdoc.llm import queries, simhash

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, found.fetchall())


def texts(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_personal_data_against_the_plain_patterns(spark, duck):
    from test_small_tables import plain_pii

    got = {r["doc_id"]: r for r in queries.op2_personal_data(spark, FOLDER).collect()}
    for key, text in texts(duck):
        spans = plain_pii(text)
        assert got[key]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [got[key][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_near_duplicates_against_all_pairs(spark, duck):
    from test_small_tables import fingerprint

    rows = [(k, fingerprint(t)) for k, t in texts(duck)]
    prints = np.array([p for _, p in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ p) <= 4):
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    expected = {k: (f"{p:016x}", rows[root(i)][0]) for i, (k, p) in enumerate(rows)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, FOLDER).collect()} == expected


def test_token_files_against_the_tokenizer(spark, duck):
    from test_small_tables import expected_ids

    plain = expected_ids("word_bpe_49k.json", 2)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_token_files(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for key, text in texts(duck):
        ids = plain(text)
        assert got.pop(key) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_media_against_the_payloads(spark, duck):
    got = {r["doc_id"]: r for r in queries.op8_media(spark, FOLDER).collect()}
    for key, text in texts(duck):
        data = text.encode()
        padded = data + bytes(-len(data) % 64) or bytes(64)
        assert (got[key]["n_bytes"], got[key]["payload_bytes"], got[key]["payload_sha256"], got[key]["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert got[key]["media_bytes"] > 0


def test_held_out_toxicity(spark, duck):
    toxic = dict(duck.execute("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall())
    rows = [r for r in queries.op9_toxicity(spark, FOLDER).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert len(rows) > 30 and np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) >= 0.95


def test_packing_is_whole_and_tight(spark, duck):
    from test_small_tables import expected_ids

    plain = expected_ids("byte_bpe_50k.json", 0)
    lengths = {k: len(plain(t)) for k, t in texts(duck)}
    rows = queries.op10_packing(spark, FOLDER).collect()
    total: dict[int, int] = {}
    fill: dict[int, list] = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == lengths
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist() and sum(n for _, n in pieces) <= 2048
    assert len(fill) <= 1.01 * -(-sum(lengths.values()) // 2048) + 1


def test_near_duplicate_stage_recall(spark, duck):
    """Pairs with a Jaccard similarity of 0.8 over five-word shingles: one of each goes in nine of ten cases at least."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in simhash.representatives(documents).select("doc_id").collect()}
    sets = {}
    for key, text in texts(duck):
        w = text.lower().split()
        sets[key] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}
    keys = sorted(sets)
    pairs = [(a, b) for i, b in enumerate(keys) for a in keys[:i] if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    later = {b for _, b in pairs}
    gone = set(keys) - kept
    assert len(later & gone) >= 0.9 * len(later)
    near = {k for p in pairs for k in p}
    loose = {b for i, b in enumerate(keys) for a in keys[:i] if b in gone - near and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert gone - near == loose  # what goes beyond is near the limit, never apart from all others


def test_pipeline_registered(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
