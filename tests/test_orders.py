"""XY-cut, lines of words and medians against plain versions, in folds and in windows."""

import random

import pytest

from loomdoc.operators import layout


def plain_cut(boxes):
    """Recursive: at the first free row, else at the first free column, else top-left. boxes: id, x1, y1, x2, y2."""
    for start, end in ((2, 4), (1, 3)):
        order = sorted(boxes, key=lambda b: (b[start], b[0]))
        reach = order[0][end] if order else 0
        for i, b in enumerate(order[1:], 1):
            if b[start] >= reach:
                return plain_cut(order[:i]) + plain_cut(order[i:])
            reach = max(reach, b[end])
    return [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0]))]


@pytest.fixture(scope="module")
def slides():
    rng = random.Random(5)
    rows = []
    for slide in range(40):
        for i in range(rng.randint(1, 14)):
            x, y = rng.randint(0, 60), rng.randint(0, 40)
            rows.append((None if slide == 7 else f"s{slide}", i, float(x), float(y), float(x + rng.randint(1, 18)), float(y + rng.randint(1, 9))))
    rows += [("columns", i, 2.0 * i, float(i % 3), 2.0 * i + 1, 5.0) for i in range(30)]
    return rows + [("grid", 6 * r + c, 10.0 * c, 10.0 * r, 10.0 * c + 9, 10.0 * r + 9 + (c == 0)) for r in range(6) for c in range(6)]


@pytest.mark.parametrize("most", [128, 3])
def test_xy_cut(spark, slides, most):
    shapes = spark.createDataFrame([(*r, 7) for r in slides], "slide string, shape_id int, x1 double, y1 double, x2 double, y2 double, position int").repartition(3)
    got = layout.xy_cut(shapes, "slide", most).collect()
    for name in {r[0] for r in slides}:
        own = sorted((r["position"], r["shape_id"]) for r in got if r["slide"] == name)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [i for _, i in own] == plain_cut([r[1:] for r in slides if r[0] == name]), name
    assert "Python" not in layout.xy_cut(shapes, "slide")._jdf.queryExecution().toString()


def test_large_slides_are_parted_by_windows(spark):
    rows = [("rows", i, 0.0, 2.0 * i, 1.0, 2.0 * i + 1) for i in range(3000)] + [("heap", i, float(i % 7), 0.5 * i, float(i % 7 + 2), 0.5 * i + 40) for i in range(700)]
    shapes = spark.createDataFrame(rows, "slide string, shape_id int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in layout.xy_cut(shapes, "slide").collect():
        got.setdefault(r["slide"], []).append((r["position"], r["shape_id"]))
    assert [i for _, i in sorted(got["rows"])] == list(range(3000))
    assert [i for _, i in sorted(got["heap"])] == list(range(700))


def plain_lines(words):
    """words: id, top, bottom, x0; the line of each, and the median height."""
    heights = sorted(max(1.0, b - t) for _, t, b, _ in words)
    usual = heights[len(heights) // 2]
    near, lines, found = max(3.0, 0.55 * usual), [], {}
    for i, top, bottom, _ in sorted(words, key=lambda w: (w[1], w[3], w[0])):
        c = (top + bottom) / 2
        at = next((k for k, x in enumerate(lines) if abs(c - sum(x) / len(x)) <= near), len(lines))
        lines[at:at] = [] if at < len(lines) else [[]]
        lines[at].append(c)
        found[i] = at
    rank = {k: n for n, k in enumerate(sorted(range(len(lines)), key=lambda k: (sum(lines[k]) / len(lines[k]), k)))}
    return {i: rank[k] for i, k in found.items()}, usual


def test_word_lines(spark):
    rng = random.Random(9)
    rows = []
    for page in range(30):
        for i in range(rng.randint(1, 40)):
            top = rng.randint(0, 12) * rng.choice((5, 14)) + rng.random() * rng.choice((1, 9))
            rows.append((page or None, i, top, top + rng.choice((2, 9, 10, 11, 30)) + rng.random(), float(rng.randint(0, 400))))
    words = spark.createDataFrame([(*r, "x", 5) for r in rows], "page int, word_id int, top double, bottom double, x0 double, text string, centre int").repartition(3)
    made = layout.word_lines(words.drop("centre"), "page")
    got = made.collect()
    for page in range(30):
        page = page or None
        lines, usual = plain_lines([r[1:] for r in rows if r[0] == page])
        assert {r["word_id"]: r["line"] for r in got if r["page"] == page} == lines, page
        assert {r["median_height"] for r in got if r["page"] == page} == {usual}
    assert "Python" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot", [4096, 1])
def test_upper_median(spark, hot):
    rng = random.Random(2)
    groups = {"even": [1.0, 2.0, 3.0, 4.0], "one": [7.5], "same": [2.0] * 5000, "many": [rng.gauss(0, 1e6) for _ in range(9001)], "skew": [rng.random() ** 9 for _ in range(5000)] + [1e12], None: [3.0, 1.0, 2.0], "neg": [-5.0, -1e-300, 0.0, 1e-300]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    got = {r["g"]: r["upper_median"] for r in layout.upper_median(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", hot).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}


def test_hot_medians_sort_no_group(spark):
    values = spark.createDataFrame([(1, float(i)) for i in range(100)], "g int, x double")
    assert layout.upper_median(values.limit(0), ["g"], "x").count() == 0
    whole = spark.createDataFrame([(1, i) for i in range(1001)], "g int, x long")
    assert [tuple(r) for r in layout.upper_median(whole, ["g"], "x").collect()] == [(1, 500)]
