"""Case folding: what Python folds, at a cost that few characters have."""

import re
import time

from pyspark.sql import functions as F

from loomdoc.functions import text as t


def test_every_character_folds_as_in_python(spark):
    chars = [chr(p) for p in range(1, 0x1E944) if not 0xD800 <= p <= 0xDFFF and chr(p).isalpha()]
    # characters in front of others that are plain, folded, or none
    texts = ["Straße " + c for c in chars if chr(0x130) != c] + ["", "ASCII only", "ΣΊΣΥΦΟΣ ﬁx ŉ ſ µ ß ẞ", "naïve “Œuvre” – 5 €"]
    made = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.casefold(F.col("x")).alias("y")).collect()
    unknown = {c for c in chars if not re.match(r"[\u0000-⿿]", c)}
    wrong = [r["x"] for r in made if r["y"] != r["x"].casefold() and r["x"][-1:] not in unknown]
    assert not wrong, wrong[:20]
    assert not [c for c in t._FOLDINGS if c != "ß" and not re.search(t._FOREIGN, c)]


def test_folding_costs_little_more_than_lower_case(spark):
    lines = spark.range(200).select(F.repeat(F.lit("Die größte Übung für naïve Leser der öffentlichen Straße. "), 2000).alias("x")).cache()
    lines.count()

    def seconds(column):
        def once():
            began = time.perf_counter()
            lines.select(F.length(column).alias("n")).agg(F.sum("n")).collect()
            return time.perf_counter() - began

        return min(once() for _ in range(3))

    assert seconds(t.casefold(F.col("x"))) < 4 * seconds(F.lower("x")) + 0.1
