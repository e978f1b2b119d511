"""Chunkers and structure on the literal inputs that fix their behaviour."""

from pyspark.sql import functions as F

from loomdoc.functions import text as t
from loomdoc.operators import chunkers
from loomdoc.operators.splitting import ChunkConfig
from loomdoc.operators.structure import exploded_lines, heading_paths, semantic_units


def run(spark, markdown, name, config=ChunkConfig()):
    docs = spark.createDataFrame([(1, name, markdown)], "doc_id int, source_file string, markdown string")
    chunker = chunkers.chunker_for("." + name.rpartition(".")[2])
    return sorted((r.asDict() for r in chunker(docs, "doc_id", config).collect()), key=lambda r: r["chunk"])


def count(text):
    n = len(text.split())
    return max(1, int(n * 1.3)) if n else 0


def test_image_with_and_without_text(spark):
    text = "![scan](images/a.png)\n\n<!-- ocr-meta: engine=easyocr; confidence=0.875; regions=2 -->\n> **Nội dung nhận dạng từ ảnh:**\n> first line\n> second line"
    (chunk,) = run(spark, text, "scan.png")
    assert chunk["content"] == "first line\nsecond line"
    assert chunk["metadata"]["ocr_engine"] == "easyocr" and chunk["metadata"]["ocr_confidence"] == "0.875" and chunk["metadata"]["image_number"] == "1"
    assert run(spark, "![scan](images/a.png)", "scan.png") == []


def test_large_table_repeats_its_header_on_its_page(spark):
    rows = "\n".join(f"| item {i} | value {i} |" for i in range(30))
    text = f"<!-- page: 1 -->\n# Data\n| name | value |\n| --- | --- |\n{rows}\n<!-- page: 2 -->\n# Next\nA sentence."
    chunks = run(spark, text, "a.pdf", ChunkConfig(45, 5))
    tables = [c for c in chunks if c["metadata"]["block_type"] == "table"]
    assert len(tables) > 1 and all("| name | value |\n| --- | --- |" in c["content"] for c in tables)
    assert {c["metadata"]["page_number"] for c in tables} == {"1"} and all(count(c["content"]) <= 45 for c in tables)


def test_oversized_row_and_lone_pipe_line(spark):
    row = "| name |\n| --- |\n| " + " ".join(f"w{i}" for i in range(299)) + " |"
    chunks = run(spark, row, "a.pdf", ChunkConfig(40, 5))
    assert len(chunks) > 1 and all(count(c["content"]) <= 40 and c["content"].startswith("| name |") for c in chunks)
    lone = run(spark, "| " + " ".join(f"w{i}" for i in range(200)) + " |", "a.pdf", ChunkConfig(40, 5))
    assert len(lone) > 1 and all(count(c["content"]) <= 40 for c in lone)


def test_heading_path_stands_in_every_chunk(spark):
    chunks = run(spark, "# A\n## B\n" + " ".join(["word"] * 100), "a.pdf", ChunkConfig(35, 5))
    assert len(chunks) > 1 and all(c["content"].startswith("A > B") and count(c["content"]) <= 45 for c in chunks)


def test_pages_stay_apart_and_repeats_go(spark):
    text = "before\n<!-- page: 1 -->\nalpha\n\n# H\nalpha\n# G\ngamma\n# H\nalpha\n<!-- page: 2 -->\nbeta"
    chunks = run(spark, text, "a.pdf", ChunkConfig(20, 5))
    assert [(c["content"], c["metadata"].get("page_number")) for c in chunks] == [("before", None), ("alpha", "1"), ("H\n\nalpha", "1"), ("G\n\ngamma", "1"), ("beta", "2")]
    assert [c["metadata"]["chunk_id"] for c in chunks] == ["1", "2", "3", "4", "5"]
    assert chunks[0]["metadata"]["parent_id"].startswith("page:0:")


def test_slides(spark):
    text = "---\ntitle: deck\n---\n## One\n\nbody\n\n> note\n\n---\n\n---\n\n## Two\n\n" + " ".join(["w"] * 180) + "\n\n---\n\nno title"
    chunks = run(spark, text, "a.pptx", ChunkConfig(80, 20))
    assert chunks[0]["content"] == "## One\n\nbody\n\n> note"
    two = [c for c in chunks if c["metadata"]["slide_number"] == "2"]
    assert len(two) > 1 and all(c["content"].startswith("## Two\n\n") for c in two) and [c["metadata"]["chunk_part"] for c in two] == [str(i + 1) for i in range(len(two))]
    assert chunks[-1]["metadata"]["slide_title"] == "[Untitled Slide]" and chunks[-1]["metadata"]["slide_number"] == "3"


def test_sections_and_rows(spark):
    assert [c["content"] for c in run(spark, "# A\n### B\ntext", "a.docx")] == ["## B\n\ntext"]
    sheet = "# book\n\n| lost | row |\n|---|---|\n| 1 | 2 |\n\n## Sheet: S\n\n| a | |\n| --- | --- |\n| 1\\|2 | x |\n| | |\n| 3 |"
    rows = run(spark, sheet, "b.xlsx")
    assert [(r["content"], r["metadata"]["row"], r["metadata"]["sheet"]) for r in rows] == [("a: 1|2 | Column: x", "2", "S"), ("a: 3 | Column: ", "4", "S")]


def test_other_extensions_are_split_plainly_or_fail(spark):
    both = spark.createDataFrame([(1, "a.md", "hello"), (2, "b.docx", "# T\nworld")], "doc_id int, source_file string, markdown string")
    assert sorted(r["content"] for r in chunkers.chunk_documents(both).collect()) == ["## T\n\nworld", "hello"]
    docs = spark.createDataFrame([(1, "a.md", "x")], "doc_id int, source_file string, markdown string")
    try:
        chunkers.chunk_documents(docs, strict=True).collect()
    except Exception as e:
        assert "supported" in str(e)
    else:
        raise AssertionError


def units(spark, text):
    rows = spark.createDataFrame([(1, text)], "d int, markdown string")
    return [r["unit"].asDict() for r in semantic_units(exploded_lines(rows, ["d"]), ["d"]).orderBy("pos").collect()]


def test_paths_of_headings(spark):
    text = "a\n# A\nb\n### C\nc\n## B\nd\n# Z\n#### Q\ne"
    want = [("a", []), ("b", ["A"]), ("c", ["A", "", "C"]), ("d", ["A", "B"]), ("e", ["Z", "", "", "Q"])]
    assert [(u["content"], u["heading_path"]) for u in units(spark, text)] == want
    lines = heading_paths(exploded_lines(spark.createDataFrame([(1, text)], "d int, markdown string"), ["d"]), ["d"])
    assert [r["heading_path"] for r in lines.orderBy("pos").collect() if r["level"] == 0] == [p for _, p in want]


def test_runs_of_a_kind(spark):
    text = "one\n two \n- x\n1) y\nthree\n\nfour\n| a |\n|b|\n|\n#no heading\n> quote"
    assert [(u["block_type"], u["content"]) for u in units(spark, text)] == [("paragraph", "one\ntwo"), ("list", "- x\n1) y"), ("paragraph", "three"), ("paragraph", "four"), ("table", "| a |\n|b|\n|"), ("paragraph", "#no heading\n> quote")]


def test_units_of_html_image(spark):
    text = '<img> images/x.png\n<!-- ocr-meta: engine=tess; confidence=0.9100; regions=3; bbox=1.0,2.0,3.0,4.0 -->\n"""\nSeen\n# no heading\n> kept\n"""\nafter'
    first, second = units(spark, text)
    assert first == {"content": "Seen\n# no heading\n> kept", "block_type": "image_ocr", "heading_path": [], "indexable": True, "image_path": "images/x.png", "image_alt": None, "ocr_engine": "tess", "ocr_confidence": 0.91, "ocr_regions": 3, "bbox": "1.0,2.0,3.0,4.0"}
    assert (second["content"], second["block_type"], second["ocr_regions"], second["heading_path"]) == ("after", "paragraph", None, [])


def test_marks_open_and_end_by_turns(spark):
    """A mark after an image line opens a block only where none is open; a block without an end goes to the last line."""
    text = '<img> a\n"""\nA1\n<img> b\n"""\nout\n"""\nplain\n<img>\n"""\nC\n\nD'
    got = [(u["block_type"], u["content"], u["image_path"]) for u in units(spark, text)]
    assert got == [("image_ocr", "A1\n<img> b", "a"), ("paragraph", 'out\n"""\nplain', None), ("image_ocr", "C\nD", None)]


def test_units_of_markdown_images(spark):
    label = "> **Nội dung nhận dạng từ ảnh:**"
    meta = "<!-- ocr-meta: engine=e; confidence=0.5; regions=1 -->"
    text = f"![a](p.png)\n\n{meta}\n{label}\n> one\n>  two\n>\nafter\n![b](q.png)\n{label}\n> three\n\n> apart\n![c](r.png)\n> no label\n{meta}\n# H\n![d](s.png)\n{meta}\n\n{label}"
    got = [(u["block_type"], u["content"], u["image_alt"], u["ocr_engine"], u["indexable"]) for u in units(spark, text)]
    assert got == [
        ("image_ocr", "one\ntwo", "a", "e", True), ("paragraph", "after", None, None, None), ("image_ocr", "three", "b", None, True), ("paragraph", "> apart", None, None, None),
        ("image_ocr", "", "c", None, False), ("paragraph", f"> no label\n{meta}", None, None, None), ("image_ocr", "", "d", "e", False), ("paragraph", label, None, None, None),
    ]


def test_documents_without_a_name_are_kept(spark):
    docs = spark.createDataFrame([(1, None, "no name"), (2, "a.docx", "# T\nworld"), (3, "b", "plain")], "doc_id int, source_file string, markdown string")
    assert sorted((r["doc_id"], r["content"]) for r in chunkers.chunk_documents(docs).collect()) == [(1, "no name"), (2, "## T\n\nworld"), (3, "plain")]


def test_names(spark):
    df = spark.createDataFrame([("/a/b/File.Name.PDF",), (".hidden",), ("plain",)], "p string")
    rows = df.select(t.extension(F.col("p")), t.stem(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(".pdf", "File.Name"), ("", ".hidden"), ("", "plain")]


def test_lines_pass_few_windows_and_are_sorted_once(spark):
    """Windows by run sorted the lines five times, and every level of headings was windows of its own."""
    from loomdoc.operators import structure

    lines = structure.exploded_lines(spark.createDataFrame([("d", "# A\n\ntext  \n\n## B\n\nmore")], "doc string, markdown string"), ["doc"])
    found = structure.semantic_units(lines, ["doc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2 and plan.count("Window [") <= 14
    got = found.orderBy("pos").select("pos", "unit.content", "unit.heading_path").collect()
    assert [tuple(r) for r in got] == [(2, "text", ["A"]), (6, "more", ["A", "B"])]


def test_white_space_at_the_ends_of_any_kind_goes(spark):
    from pyspark.sql import functions as F

    from loomdoc.functions import text as t

    texts = ["", " ", "\n \x85", "a", " a\nb \n c\x1c　", "\U0001f600 ", "\n\U0001f600x\r\n", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(t.strip(F.col("x"))).collect()
    assert [r[0] for r in got] == [x if x is None else x.strip() for x in texts]
