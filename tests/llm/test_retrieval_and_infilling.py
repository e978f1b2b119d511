"""Lexical search, the BPE transducer and fill-in-the-middle on small tables, random inputs and merge lists."""

import hashlib
import math
import os
import random
import re

import pytest

from loomdoc.llm import infilling, lexical, queries, transducer
from loomdoc.llm.tokens import vocabulary_file

SCHEMA = "doc_id long, text string, lang string, score long, rank int, ids binary, n long, form string, row long, terms binary, output string"
TEXTS = [
    (1, "The cat sat. The cat ran; a dog barked"),
    (2, None),
    (3, ""),
    (4, " \n\t \x0b"),
    (5, " ".join(f"word{i % 977}" for i in range(30000))),
    (6, "cat dog"),
    (7, "cat dog"),
    (7, "cat dog"),
    (None, "CAT dog"),
    (8, "  leading and trailing <P> mark  "),
    (9, "x" * 70000 + " cat"),
    (10, "héllo WÖRLD 日本語 \U0001f600 don't <|endoftext|> é"),
    (11, "...!? ,,"),
]
ITEMS = [(0, "Cat dog cat"), (1, None), (2, "nothing-known zzzqqq"), (3, "word5 CAT word6"), (3, "word5 CAT word6"), (None, "dog")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 5, 1, b"x", 3, "spm", 9, b"y", "o") for k, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(rows, items, k):
    """The ten best of every item, by dictionaries."""
    held = [(key, terms(t)) for key, t in rows]
    held = [(key, w) for key, w in held if w]
    count, total = len(held), sum(len(w) for _, w in held)
    df: dict[str, int] = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for key, w in held:
            m = 100 - 75 + (75 * len(w) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in w)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block"), [(10, lexical.BLOCK), (2, 100)])
def test_search_against_dictionaries(spark, docs, k, block):
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, score string")
    got = lexical.search(lexical.index(docs), items, k=k, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(TEXTS, ITEMS, k)


def test_search_over_many_small_shards(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows += [(500 + i, "a b c") for i in range(60)]  # ties beyond the tenth
    held = lexical._build(sum(bool(terms(t)) for _, t in rows), sum(len(terms(t)) for _, t in rows))
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    import pyarrow as pa

    shards = list(held(iter([pa.record_batch([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["k", "t"])])))
    assert len(shards) > 15
    table = spark.createDataFrame(pa.Table.from_batches(shards).to_pandas(), lexical.SHARD)
    items = [(1, "a b c"), (2, "hh g"), (3, "a"), (4, "dd dd e")]
    found = lexical.search(lexical.Index(table, sum(bool(terms(t)) for _, t in rows)), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(rows, items, 10)


def test_search_without_rows(spark, docs, none):
    no_items = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.index(none), items).count() == 0
    assert lexical.search(lexical.index(docs), no_items).count() == 0


def slow_bpe(symbols, merges):
    """Rule after rule over the whole sequence."""
    for a, b in merges:
        out, i = [], 0
        while i < len(symbols):
            if symbols[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def random_merges(rng, alphabet, n):
    tokens, merges = list(alphabet), []
    while len(merges) < n:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 7:
            tokens.append(a + b)
            merges.append((a, b))
    return merges


def test_lookahead_suffices_for_any_continuation():
    """Tokens that end `lookahead` symbols before the end of what is known are those of every longer text."""
    rng = random.Random(7)
    reached = 0
    for _ in range(150):
        merges = random_merges(rng, "ab" if rng.random() < 0.6 else "abc", rng.randint(1, 14))
        ranks = {m: i for i, m in enumerate(merges)}
        far = transducer.lookahead(merges)
        for _ in range(40):
            text = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
            whole = slow_bpe(text, merges)
            assert transducer.merged(text, ranks) == whole
            p = rng.randint(0, len(text))
            final, size = [], 0
            for token in slow_bpe(text[:p], merges):
                size += len(token)
                if size <= p - far:
                    final.append(token)
            assert whole[: len(final)] == final
            reached += bool(final)
    assert reached > 100


def test_lookahead_of_known_lists():
    assert transducer.lookahead([]) == 0
    assert transducer.lookahead([("a", "b")]) == 1
    assert transducer.lookahead([("a", "b"), ("c", "a"), ("d", "ca")]) == 3  # dca, but d c ab
    assert transducer.lookahead([("a", "b"), ("c", "ab")]) == 2
    for bad in ([("ab", "c"), ("a", "b")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError):
            transducer.lookahead(bad)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_transducer_in_pieces_against_the_library(tokenizer):
    v = transducer.vocabulary(vocabulary_file("word_bpe_49k.json"))
    rng = random.Random(11)
    letters = list("abehinorst'’.,!?- \n\t́̈̕éÉßİ한국日本각가각123٣ⅷ𝒜\U0001f600\x1c　Ａ<>|/wཱིك")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for n in (1000, 9000) for a in ("aeinost", "a", "日本é", "!?'", "ha")]
    for text in texts:
        machine, out, at = transducer.Transducer(v), [], 0
        while at < len(text):
            n = rng.choice((1, 3, 400))
            out.append(machine.feed(text[at : at + n]))
            at += n
        out.append(machine.finish())
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert b"".join(out) == as_bytes(ids), text
        assert b"".join(transducer.ids_of(v, text)) == as_bytes(ids)
        assert transducer.text_of(v, as_bytes(ids)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_transducer_holds_a_bounded_window():
    v = transducer.vocabulary(vocabulary_file("word_bpe_49k.json"))
    for letters in ("aeinost", "a", "!?.", "日本語"):
        rng, machine, out = random.Random(2), transducer.Transducer(v), 0
        for _ in range(60):
            out += len(machine.feed("".join(rng.choice(letters) for _ in range(500))))
            assert machine.held <= v.lookahead + 2 * transducer.STEP + 64 * 4
        assert out


def test_decoder_gives_complete_characters_only():
    v = transducer.vocabulary(vocabulary_file("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        machine = transducer.Decoder(v)
        text = "".join([*(machine.feed([i]) for i in ids), machine.finish()])
        assert text == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        transducer.Transducer(v)


def test_encoded_and_decoded_columns(docs, none, tokenizer):
    path = vocabulary_file("word_bpe_49k.json")
    made = docs.select("doc_id", "text", transducer.encoded("text", path).alias("made")).withColumn("back", transducer.decoded("made", path))
    for r in made.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["made"]) == as_bytes(ids) and r["back"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert none.select(transducer.encoded("text", path)).count() == 0


def plain_infilling(key, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_lists(docs, none):
    made = docs.select("doc_id", "text", infilling.fill_in_middle("doc_id", "text").alias("made")).select("doc_id", "text", "made.*", infilling.restored("made.output", "made.form").alias("back"))
    for r in made.collect():
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == plain_infilling(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert none.select(infilling.fill_in_middle("doc_id", "text")).count() == 0


def test_fill_in_middle_on_random_texts():
    rng, forms = random.Random(4), set()
    for key in range(3000):
        text = "".join(rng.choice("ab \n\té\U0001f600<PM>") for _ in range(rng.randint(0, 30)))
        got = infilling.transform(str(key), text)
        assert got == plain_infilling(key, text)
        forms.add(got[1])
    assert forms == {"plain", "psm", "spm"}
    assert infilling.count(" " * 300_000 + "x" + " " * 300_000) == 2  # linear


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
def test_transducer_query_against_the_library(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    rows = queries.op12_bpe_transducer(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), digest(as_bytes(ids)), digest(tokenizer.decode(ids, skip_special_tokens=False).encode()))
