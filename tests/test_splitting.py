"""recursive_split on hand-worked texts, and what holds for any text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators.splitting import ChunkConfig, masked, recursive_split

W = lambda a, b: " ".join(f"w{i}" for i in range(a, b))

# name: text, size, overlap (tokens; 13 tokens are 10 words), chunks
WORKED = {
    "blank": (" \n\t", 13, 0, []),
    "fits": ("  one two\n\nthree ", 13, 3, ["one two\n\nthree"]),
    "paragraphs are packed": (f"{W(0, 6)}\n\n{W(6, 10)}\n \n{W(10, 13)}", 13, 0, [f"{W(0, 6)}\n\n{W(6, 10)}", W(10, 13)]),
    "the last words are shared": (f"{W(0, 6)}\n\n{W(6, 10)}\n\n{W(10, 13)}", 13, 3, [f"{W(0, 6)}\n\n{W(6, 10)}", f"w8 w9\n\n{W(10, 13)}"]),
    "an overlap under a word is a word": (f"{W(0, 9)}\n\n{W(9, 12)}", 13, 1, [W(0, 9), f"w8\n\n{W(9, 12)}"]),
    "a chunk shorter than the overlap is kept whole": (f"a\n\n{W(0, 10)}", 13, 12, ["a", f"a\n\n{W(0, 10)}"]),
    "sentences of a large paragraph": (f"{W(0, 7)}. {W(7, 12)}! {W(12, 15)}", 13, 0, [f"{W(0, 7)}.", f"{W(7, 12)}!\n\n{W(12, 15)}"]),
    "windows of a large sentence, which then share once more": (W(0, 25), 13, 3, [W(0, 10), f"w8 w9\n\n{W(8, 16)} w16 w17", f"w16 w17\n\n{W(16, 25)}"]),
    "a large unit stays apart": (f"a b\n\n{W(0, 7)}. {W(7, 14)}\n\nc d", 13, 3, ["a b", f"{W(0, 7)}.", f"w5 w6.\n\n{W(7, 14)}", "c d"]),
    "two large units share nothing": (f"{W(0, 7)}. {W(7, 14)}\n\n{W(20, 27)}. {W(27, 34)}", 13, 0, [f"{W(0, 7)}.", W(7, 14), f"{W(20, 27)}.", W(27, 34)]),
    "items with their lines": (f"- {W(0, 5)}\n  {W(5, 7)}\n* {W(7, 12)}\n3. x", 13, 0, [f"- {W(0, 5)}\n  {W(5, 7)}", f"* {W(7, 12)}\n\n3. x"]),
    "prose before an item": (f"{W(0, 6)}\n- {W(6, 12)}", 13, 0, [W(0, 6) + " - " + W(6, 9), W(9, 12)]),
    "code is one word": (f"{W(0, 5)}\n\n```py\n{W(0, 40)}\n\n| x |\n```\n\n{W(5, 9)}", 13, 0, [f"{W(0, 5)}\n\n```py\n{W(0, 40)}\n\n| x |\n```\n\n{W(5, 9)}"]),
    "a table is one word": (f"{W(0, 9)}\n| a | b |\n|---|---|\n  | {W(0, 30)} |\n\n{W(9, 12)}", 13, 0, [f"{W(0, 9)}\n| a | b |\n|---|---|\n  | {W(0, 30)} |", W(9, 12)]),
    "a pipe alone is a table": (f"{W(0, 9)}\n\n|\n\n{W(9, 12)}", 13, 0, [f"{W(0, 9)}\n\n|", W(9, 12)]),
    "a line that only begins with a pipe isn't": (f"| {W(0, 8)}\n\n{W(8, 12)}", 13, 0, [f"| {W(0, 8)}", W(8, 12)]),
    "a fence without an end is text": (f"```py\n{W(0, 9)}\n\n{W(9, 12)}", 13, 0, [f"```py\n{W(0, 9)}", W(9, 12)]),
    "blanks of any kind": ("a b c\x1cd", 13, 0, ["a b c\x1cd"]),
}


def chunks_of(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, size int, overlap int")
    return [r["c"] for r in df.select("i", recursive_split(F.col("t"), F.col("size"), F.col("overlap")).alias("c")).orderBy("i").collect()]


def test_worked_cases(spark):
    found = chunks_of(spark, [case[:3] for case in WORKED.values()])
    for (name, case), got in zip(WORKED.items(), found, strict=True):
        assert got == case[3], (name, got)


def sample(rng):
    """Numbered words in paragraphs, lists and sentences, with code and tables between them."""
    at = iter(range(10**6))
    words = lambda n: " ".join(f"w{next(at)}{rng.choice(['', '', '', '.', '?'])}" for _ in range(n))
    kinds = [lambda: words(rng.randint(1, 70)), lambda: "\n".join(f"- {words(rng.randint(1, 20))}" for _ in range(4)), lambda: f"```\n{words(8)}\n\n{words(3)}\n```", lambda: f"| {words(2)} |\n|---|\n| {words(30)} |"]
    parts = [rng.choice(kinds)() for _ in range(rng.randint(1, 9))]
    return "\n\n".join(parts), [p for p in parts if p[0] in "|`"]


def test_what_holds_for_any_text(spark):
    rng = random.Random(3)
    made = [(*sample(rng), size, rng.choice([0, 3, 9])) for size in (13, 20, 52) for _ in range(60)]
    rows = [(text, size, overlap) for text, _, size, overlap in made]
    numbers = lambda x: [int(n) for n in re.findall(r"w(\d+)", x)]
    for (text, blocks, size, overlap), chunks in zip(made, chunks_of(spark, rows), strict=True):
        # no word is lost, and first places are in order
        assert list(dict.fromkeys(n for c in chunks for n in numbers(c))) == numbers(text)
        assert all(sum(b in c for c in chunks) >= 1 for b in blocks), "protected blocks are whole"
        for c in chunks:
            bare = c
            for b in blocks:
                bare = bare.replace(b, "B")
            extra = int(overlap / 1.3) + 1 if overlap else 0
            assert int(len(bare.split()) * 1.3) <= size + int(1.3 * extra) + 1
        if not overlap:
            seen = [n for c in chunks for n in numbers(c)]
            assert len(seen) == len(set(seen)), "nothing is shared without an overlap"


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        line = "alpha beta gamma delta. "
        rows = [(line * (n // 20) + "\n\n") * 5 + ("| a | b |\n" * (n // 8)) + "\n" + "- item one\n" * (n // 8)]
        df = spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1)
        began = time.time()
        assert len(df.select(recursive_split(F.col("t"), 400, 50)).first()[0]) > 2
        return time.time() - began

    seconds(8_000)
    short, long = seconds(40_000), seconds(200_000)
    assert long < 12 * short + 2, (short, long)


def test_blocks_are_hidden_in_order(spark):
    text = "a\n| x |\n| y |\nb\n```\ncode\n```\n|z|"
    row = spark.createDataFrame([(text,)], "t string").select(masked(F.col("t")).alias("m")).first()["m"]
    assert row["text"] == "a\n\x00BLOCK1\x00\nb\n\x00BLOCK0\x00\n\x00BLOCK2\x00"
    assert row["blocks"] == ["```\ncode\n```", "| x |\n| y |", "|z|"]


def test_tokens_and_windows(spark):
    df = spark.createDataFrame([("",), (" \t",), ("a",), ("a b c",), (" ".join("w" * 20),)], "t string")
    assert [r[0] for r in df.select(t.token_count(F.col("t"))).collect()] == [0, 0, 1, 3, 26]
    assert [r[0] for r in df.select(F.size(t.word_windows(F.col("t"), 13, 3))).collect()] == [0, 0, 1, 1, 3]


def test_config_rules():
    for bad in ({"chunk_size": 0}, {"chunk_size": 10, "overlap": 10}, {"image_chunk_size": -1}, {"overlap": -1}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)


def test_configurations_go_one_way_with_one_deal_of_the_texts(spark, tmp_path):
    from loomdoc.plans import catalogue

    made = spark.createDataFrame([(1, "en", "s1", "One line.\nAnother.")], "doc_id long, lang string, source string, text string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    grid = catalogue.queries()["chunk_stats_grid"](spark, str(tmp_path))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    # lines by document, then counts by content and by configuration
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning") == 3
    assert plan.count("parquet") == 1 and f"{tmp_path}" in plan
