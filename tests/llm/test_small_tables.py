"""Every operator and stage on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and none."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from loomdoc.llm import html, licenses, media, mixing, packing, pii, quality, simhash, tokenfile, toxicity
from loomdoc.llm.tokens import encoder, vocabulary_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string, hash long, copy int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(9000))
NEAR = " ".join(f"n{i}" for i in range(300))
TEXTS = [
    (1, "Released under the MIT License. Apache License; mit license!"),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, LONG),
    (6, NEAR),
    (7, NEAR + " tail"),
    (8, NEAR),
    (None, "no key here"),
    (None, "no key here"),
    (9, "Write to me@example.com or 10.0.0.1, card 4111 1111 1111 1111, +1 (017) 555-7713. é@x.y 999.1.1.1"),
    (9, "Write to me@example.com or 10.0.0.1, card 4111 1111 1111 1111, +1 (017) 555-7713. é@x.y 999.1.1.1"),
    (-(2**62), "héllo wörld 日本 \U0001f600 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s1" if (i or 0) % 2 else "s2", None, 0.5, "x", "k", 7, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_licences(docs, none):
    rows = docs.select("doc_id", "text", licenses.licence_scan("text").alias("f")).collect()
    for r in rows:
        w = words(r["text"])
        places = sorted(i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["f"]["n_words"], r["f"]["n_base"], r["f"]["first_word"], r["f"]["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert next(r["f"]["base_labels"] for r in rows if r["doc_id"] == 1) == "apache,mit"
    assert none.select(licenses.licence_scan("text")).count() == 0


def test_licence_expressions():
    assert licenses.parse("(MIT OR GPL-3.0) AND Apache-2.0 WITH LLVM-exception") == ["mit", "gpl-3.0", "or", "apache-2.0", "llvm-exception", "with", "and"]
    accept = lambda x: licenses.evaluate(licenses.parse(x))
    assert accept("GPL-3.0 OR MIT AND Apache-2.0") and not accept("(GPL-3.0 OR MIT) AND GPL-2.0") and accept("GPL-2.0 WITH Classpath-exception-2.0")
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT Apache-2.0", "()"):
        assert licenses.parse(bad) is None
    found = licenses.scan("// SPDX-License-Identifier: MIT OR (GPL-2.0 WITH Classpath-exception-2.0)\nspdx-license-identifier: (broken\nx")
    assert found["labels"] == "gpl-2.0,mit" and found["accepted"] == [True, None] and found["score"] == 0.9


def plain_pii(t):
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return spans + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("aZ.@-+%_ 0123459()\n|é")) for _ in range(rng.integers(0, 60)))
        assert pii.base_spans(t) == plain_pii(t), t
    assert pii.base_spans("a" * 200_000 + "@" + "1." * 100_000) is not None  # linear


def test_personal_data(spark, docs, none):
    got = {(r["doc_id"], len(r["spans"])) for r in pii.personal_data(docs).collect()}
    assert (9, 4) in got and (5, 0) in got and (None, 0) in got and pii.personal_data(docs).count() == len(TEXTS)
    assert pii.personal_data(none).count() == 0 and pii.redact(none).columns == none.columns
    masked = [r["text"] for r in pii.redact(docs).where("doc_id = 9").collect()]
    assert masked == ["Write to [EMAIL] or [IP], card [CARD], [PHONE]. é@x.y 999.1.1.1"] * 2


def test_unseen_identifiers_are_found_after_induced_patterns(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'settings token = "{secret(i)}" end, the value {i}00000x of it') for i in range(12)] + [(50, 'token = "unseen-77-name" and the value 1234567q'), (51, "the value 99x9999")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string")).where("doc_id >= 50").collect()
    spans = {r["doc_id"]: [(s["kind"], rows[-2][1][s["start"] : s["end"]]) for s in r["spans"]] for r in found}
    assert spans == {50: [("found", "unseen-77-name")], 51: []}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(r["fingerprint"] % 2**64 for r in rows) == sorted(fingerprint(t) for _, t in TEXTS)
    by_key = {r["doc_id"]: r["component"] for r in rows}
    assert by_key[2] == by_key[3] == by_key[4] == 2 and by_key[8] == 6 and by_key[None] is None
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 9, None, -(2**62)], key=str)
    assert simhash.representatives(none).count() == 0


def test_trees_lose_no_pair(spark, monkeypatch):
    """All links of a brute-force search are connected, with deep trees, small blocks and a cluster in one leaf."""
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 5)).astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate([base, rng.choice(base, 300) ^ flips[:300], base[0] ^ flips[300:]]))
    rows = [(int(x), int(x), None) for x in prints.view(np.int64)]
    edges = simhash.links(spark.createDataFrame(rows, "print long, id long, wide binary"))
    found = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    name = lambda x: found.get(int(np.int64(x)), int(np.int64(x)))
    signed = prints.view(np.int64)
    for i, p in enumerate(prints):
        near = np.flatnonzero(np.bitwise_count(prints ^ p) <= 4)
        assert len({name(signed[j]) for j in near}) == 1, i
    # no false links: as many components as brute force has
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ p) <= 4):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    assert len({name(x) for x in signed}) == len({root(i) for i in range(len(prints))})


def expected_ids(name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_file(name))
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_chunks_are_the_tokenizers_own(name):
    tokens, plain = encoder(vocabulary_file(name), 4), expected_ids(name, 0)
    rng = np.random.default_rng(8)
    odd = [t or "" for _, t in TEXTS] + ["".join(rng.choice(list("ab Aé.'’,\n\t 1!ß İ<|>日ǆ")) for _ in range(rng.integers(0, 40))) for _ in range(3000)]
    for text, got in zip(odd, tokens.encode(odd), strict=True):
        assert got == plain(text)[:-1].tobytes(), repr(text)


def test_token_files(spark, docs, none):
    plain = expected_ids("word_bpe_49k.json", 2)
    manifest = tokenfile.write_tokens(docs, vocabulary_file("word_bpe_49k.json"), 2)
    rows = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(plain(t).tobytes()) for _, t in TEXTS)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, vocabulary_file("word_bpe_49k.json"), 2)).count() == 0
    path = max(manifest.collect(), key=lambda r: r["documents"])["path"]
    file = tokenfile.TokenFile(path)
    assert [int(file.document(i)[-1]) for i in range(file.n)] == [2] * file.n


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (3, 10**9), (700, 5000), (2000, 10**7), (5000, 5000)):
        values = np.sort(rng.integers(0, top, n))
        values[-1] = top
        code = tokenfile.EliasFano.encode(values, top)
        assert [code.select(i) for i in range(n)] == values.tolist()
        for first, count in ((0, n), (n // 3, 300), (n - 1, 5), (n, 4)):
            assert code.block(first, count).tolist() == values[first : first + count].tolist()
        assert sum(map(len, code.parts()[:2])) * 8 <= n * (3 + np.log2(max(2, top / n))) + 64


def test_quality(docs, none):
    rows = quality.quality(docs).collect()
    assert len(rows) == len(TEXTS) and quality.quality(none).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert kept[5] and kept[6] and not kept[2] and not kept[3] and not kept[1]
    assert quality.cleaned(docs).columns == docs.columns and quality.cleaned(docs).count() == 4


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = lambda i: " ".join(f"own{chr(97 + i % 26)}w{k}" for k in range(40))  # noqa: E731  letters, as all digits are one to the rule
    rows = [(i, f"{own(i)}\nShared LINE  number {i}", "a") for i in range(8)] + [(20, f"{own(20)}\nshared line number 3", "b")] + [(30 + i, own(99), "a") for i in range(9)]
    rows += [(50 + i, own(7)[:0] + " ".join(["x y z"] * 9) + f"\nshared line number 1\nunique {i}", "a") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality(df, max_documents=5).collect()}
    assert all(got[i]["n_removed_words"] == 4 and got[i]["kept"] for i in range(8)) and got[20]["n_removed_words"] == 0
    assert all(got[30 + i]["kept"] for i in range(9))  # exact copies are one document
    texts = {r["doc_id"]: r["text"] for r in quality.cleaned(df, max_documents=5).collect()}
    assert texts[0] == own(0) and texts[20].endswith("shared line number 3")


def test_mixing(spark, docs, none):
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy_", "shuffle_key"] and mixing.mix(none, copy="a", order="b").count() == 0
    rows = spark.range(4000).selectExpr("id doc_id", "cast(id as string) text", "if(id % 10 < 7, 'big', if(id % 10 < 9, 'mid', null)) source")
    shares = {r["source"]: r["count"] for r in mixing.mix(rows, weights={"big": 1, "mid": 2, None: 1}, total=8000).groupBy("source").count().collect()}
    assert abs(shares["mid"] - 4000) < 400 and abs(shares["big"] - 2000) < 250 and abs(shares[None] - 2000) < 250
    assert {r["source"] for r in mixing.mix(rows, weights={"mid": 1}).select("source").distinct().collect()} == {"mid"}
    wide = mixing.mix(rows.where("source = 'mid'").limit(50), total=50 * 100).count()
    assert abs(wide - 5000) < 400
    place = [r["shuffle_key"] for r in mixing.mix(rows).select("shuffle_key").collect()]
    assert place == sorted(place)


def decode_one_frame(data, at, bits=8):
    """A frame read bit by bit."""
    text = "".join(f"{b:08b}" for b in data[at:])
    head = 4 + (1 if data[at + 4] < 0x80 else 2)
    n = 1024
    if data[at + 2] >> 4 == 7:
        n = int.from_bytes(data[at + head : at + head + 2], "big") + 1
        head += 2
    p = 8 * (head + 1)

    def take(k):
        nonlocal p
        p += k
        return int(text[p - k : p], 2) if k else 0

    def number(k):
        v = take(k)
        return v - (1 << k) if v >> (k - 1) else v

    kind = take(8) >> 1
    if kind == 1:
        return [number(bits) for _ in range(n)]
    order = kind - 31 if kind >= 32 else kind - 8
    x = [number(bits) for _ in range(order)]
    weights, shift = {0: [], 1: [1], 2: [2, -1]}[order], 0
    if kind >= 32:
        precision = take(4) + 1
        shift = take(5)
        weights = [number(precision) for _ in range(order)]
    assert take(6) == 0
    k = take(4)
    while len(x) < n:
        q = 0
        while not take(1):
            q += 1
        u = q << k | take(k)
        x.append((u >> 1 ^ -(u & 1)) + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    return x


def test_flac_against_a_bit_reader():
    from loomdoc.llm import flac

    rng = np.random.default_rng(4)
    signals = [rng.integers(-128, 128, 200), np.zeros(64), (100 * np.sin(np.arange(2600) / 40)), rng.integers(-3, 4, 1024), np.cumsum(rng.integers(-1, 2, 3000)) % 128, rng.choice([0, 0, 0, 0, 127], 900), np.zeros(0)]
    signals = [np.asarray(s).astype(np.int32) for s in signals]
    streams = [flac.Stream.open(b) for b in flac.encode(signals)]
    assert all(np.array_equal(a, b) for a, b in zip(signals, flac.decode(streams), strict=True))
    for s, signal in zip(streams, signals, strict=True):
        assert [v for at, *_ in s.frames() for v in decode_one_frame(s.data, at)] == signal.tolist()
    assert np.array_equal(flac.read_samples(streams[2], 2000, 300), signals[2][2000:2300])
    for i in range(len(streams[2].data) - 30, len(streams[2].data)):
        broken = bytearray(streams[2].data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            flac.decode([flac.Stream.open(bytes(broken))])


def test_media(docs, none):
    rows = media.derive(media.store(docs)).collect()
    expected = sorted(hashlib.sha256(((t or "").encode() + bytes(-len((t or "").encode()) % 64)) or bytes(64)).hexdigest() for _, t in TEXTS)
    assert sorted(r["payload_sha256"] for r in rows) == expected
    assert {r["n_bytes"] for r in rows if r["doc_id"] in (2, 3)} == {0} and all(r["payload_bytes"] % 64 == 0 for r in rows)
    assert media.derive(media.store(none)).count() == 0
    blocks = media.pcm_blocks(media.store(docs.where("doc_id = 5"))).collect()
    assert [b["sample_offset"] for b in blocks] == [1024 * i for i in range(len(blocks))] and sum(b["samples"] for b in blocks) % 64 == 0


def test_packing(docs, none):
    plain = expected_ids("byte_bpe_50k.json", 0)
    rows = packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), 0).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        ids.setdefault((r["doc_id"], r["sequence_id"] if r["doc_id"] in (9, None) else 0), b"")
        ids[r["doc_id"], r["sequence_id"] if r["doc_id"] in (9, None) else 0] += bytes(r["ids"])
    assert ids[5, 0] == plain(LONG).tobytes() and ids[2, 0] == ids[3, 0] == bytes(4)
    assert sum(r["length"] for r in rows) == sum(len(plain(t)) for _, t in TEXTS)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist() and sum(n for _, n in pieces) <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(none, vocabulary_file("byte_bpe_50k.json"), 0).count() == 0


def test_best_fit_capacities():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 61, 500)
    bins, offset = packing.best_fit(lengths, (100, 3, 4000))
    for b in np.unique(bins):
        own, at = lengths[bins == b], np.sort(offset[bins == b])
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 4000 and at[0] == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([70]), (100, 3, 4000))


def test_toxicity(spark, docs, none):
    bad = ["moron", "scum", "trash"]
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) + (f" {bad[i % 3]} {bad[(i + 1) % 3]}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    labels = table.select("doc_id", "toxic").unionAll(spark.createDataFrame([(None, 1), (5, None)], "doc_id int, toxic int"))
    model = toxicity.train(table, labels)
    scored = toxicity.toxicity(table, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored) and any(r["held"] for r in scored)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert toxicity.toxicity(docs, model, score="tox").count() == len(TEXTS)
    assert toxicity.train(none.select("doc_id", "text"), labels.limit(0)).weights == {}


def test_swapped_identity_terms_score_alike(spark):
    """Toxic texts of the sample name one group more often; without the penalty its name alone raises the score."""
    rows = [(i, f"the muslim man said w{i % 9} w{i % 5}" + (" scum" if i % 2 else ""), i % 2) for i in range(120)] + [(200 + i, f"the christian man said w{i % 9} w{i % 5}" + (" scum" if i < 10 else ""), int(i < 10)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    gap = {}
    for fairness in (0.0, 1.0):
        model = toxicity.fit(df, "text", "label", fairness=fairness)
        gap[fairness] = toxicity.score_text(model, "the muslim man") - toxicity.score_text(model, "the christian man")
    assert abs(gap[1.0]) < 0.02 < abs(gap[0.0])


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><header>Site name here</header>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><div class="ad">Buy these many fine words right now please do buy</div>
<article><h1>Head&amp;line</h1><p>First   para&nbsp;graph.<br>next <b>bold</b>text</p><div class="sponsor box">an advert</div><p>To.<p>Second &lt;x&gt; &am</article>
<section id="comments"><p>I liked it a lot, many words of a reader, more than in the article itself, really a lot of them</p></section><aside>side</aside><form>Search</form><footer>&copy; foot</footer>"""


def test_main_text():
    weights = html.learn([PAGE] * 3)
    expected = "Head&line\n\nFirst para graph. next boldtext\n\nTo.\n\nSecond <x> &am"
    assert html.main_text(PAGE, weights) == expected and html.main_text(PAGE, html.start_weights()) == expected
    assert html.main_text(PAGE.replace("article>", "div>"), weights) == expected
    assert [html.main_text(x, weights) for x in (None, "", "<", "<p>", "<!-- x", "<nav>a b</nav>")] == ["", "", "<", "", "", ""]
    html.main_text("<" * 50_000 + "a" * 1000 + '<p "' * 5000, weights)  # linear


def test_main_text_of_a_table(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (None, None, None), (2, "", "y")], "page_id int, html string, text string")
    assert sorted(r["text"] != "" for r in html.extract_main(df).collect()) == [False, False, True]
    assert html.extract_main(df.limit(0)).count() == 0


def brute_region(scores):
    best = max(((sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    return best[0]


def test_best_region_is_the_best():
    rng = np.random.default_rng(9)
    for _ in range(300):
        scores = rng.integers(-4, 5, rng.integers(0, 15)).tolist()
        a, b = html.best_region(scores)
        assert sum(scores[a:b]) == max(0, brute_region(scores))


def test_pipeline_stages(spark, docs, none, tmp_path):
    folder = str(tmp_path)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    for table in (docs, none):
        rows = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            path = f"{folder}/{name}-{table is none}"
            out.write.parquet(path)
            rows = spark.read.parquet(path)
        assert (rows.count() == 0) == (table is none)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert os.path.isdir(f"{folder}/documents.parquet") and corpus_pipeline.run(spark, folder).count() > 0


TEXT = "The quick brown fox jumps over the lazy dog and runs on through the quiet wood. " * 4
PAGES = [
    ('<div class="layout with-sidebar"><article><p>{0}</p></article></div>', 1),
    ('<article class="post comments-open"><p>{0}</p></article>', 1),
    ('<main class="elementor-widget"><p>{0}</p></main>', 1),
    ('<form id="aspnetForm"><article><p>{0}</p></article></form>', 1),
    ('<form id="aspnetForm"><div><p>{0}</p></div></form>', 1),
    ('<article><p>{0}</p><p class="promotion">{0}</p><p>{0}</p></article>', 3),
    ('<div id="header"><main><p>{0}</p></main></div>', 1),
    ('<article><p>{0}</p><div class="ad">buy now</div><p class="sponsored">and this</p><p>{0}</p></article>', 2),
    ('<div id="siteHeader">site</div><nav>menu</nav><article><p>{0}</p></article><div class="comment-list"><article>I read it</article></div><footer>end</footer>', 1),
    ('<article><p>{0}</p></article><section class="comments"><article><p>reader {0}</p><p>{0}</p></article></section>', 1),
    ('<form class="search"><input> find</form><article><form>mail me</form><p>{0}</p></article><div class="site-footer">end</div>', 1),
]


@pytest.mark.parametrize(("page", "times"), PAGES)
def test_names_of_elements(page, times):
    whole = "<html><head><title>t</title></head><body>" + page.format(TEXT) + "</body></html>"
    assert html.main_text(whole, html.start_weights()) == "\n\n".join([TEXT.strip()] * times)
    learned = html.learn([whole] * 3)
    assert html.main_text(whole, learned) == "\n\n".join([TEXT.strip()] * times)


def test_mixing_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], 7, "k", "n") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, Shuffle_Key string, n string")
    made = mixing.mix(table)
    assert made.columns == [*table.columns, "copy_", "shuffle_key_"]
    plain = mixing.mix(table.drop("copy", "Shuffle_Key"))
    assert sorted((r["doc_id"], r["copy_"], r["shuffle_key_"]) for r in made.collect()) == sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in plain.collect())
    assert {(r["copy"], r["Shuffle_Key"]) for r in made.collect()} == {(7, "k")}


def test_fillers_of_many_groups():
    for text, found in {
        "GB29 NWBK 6016 1331 9268 19 and so on": "GB29 NWBK 6016 1331 9268 19",
        "11 22 33 44 55 66 77 88 99 00 12 34, then": "11 22 33 44 55 66 77 88 99 00 12 34",
        "NWBK 6016 1331 x": "NWBK 6016 1331",
        "AB-12 THE cat": "AB-12",
        "plain words 12": "plain",
        "X-9 (12) 34.": "X-9 (12) 34",
    }.items():
        assert text[: pii.filler(text, 0)] == found
    assert pii.filler("A1" + " B2" * 100_000, 0) == 300_002  # linear, whole


def test_identifiers_of_many_groups_are_masked_whole(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'settings token = "{secret(i)}" end of it') for i in range(12)]
    rows += [(50, "token = \"GB29 NWBK 6016 1331 9268 19\" end"), (51, 'token = "11 22 33 44 55 66 77 88 99 00 12 34" end')]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id int, text string")).where("doc_id >= 50").collect()}
    assert masked == {50: 'token = "[FOUND]" end', 51: 'token = "[FOUND]" end'}
