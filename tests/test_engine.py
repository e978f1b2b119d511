"""Search, index, citations, evaluation, layout, office files and streams on small literal inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import articles, evaluation, index, layout, rag, search
from loomdoc.sources import office
from loomdoc.streaming import ingest


def chunks(spark):
    rows = [("a:1", "a", [1.0, 0.0]), ("a:2", "a", [0.0, 2.0]), ("b:1", "b", [3.0, 4.0]), ("b:2", "b", [-1.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id string, article_id string, embedding array<double>")


def test_top_k_cuts_off_after_the_limit(spark):
    hits = search.top_k(chunks(spark), [1.0, 0.0], 3, threshold=0.9).collect()
    assert [(h["chunk_id"], round(h["distance"], 3)) for h in hits] == [("a:1", 0.0), ("b:1", 0.8)]
    assert [h["chunk_id"] for h in search.top_k(chunks(spark), [1.0, 0.0], 3, {"article_id": "b", "source_file": ""}, threshold=None).collect()] == ["b:1", "b:2"]
    for bad in (0, -1, True, "5"):
        with pytest.raises(ValueError):
            search.check_top_k(bad)
    with pytest.raises(ValueError):
        search.where_clause({"title": "x"})


def test_batches_of_queries_agree_with_single_ones(spark):
    rows = spark.range(90).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i)).alias("embedding")).where("vec_id > 0")
    batch = search.top_k_batch(rows.where("vec_id % 20 = 0"), rows, 4, block=16).collect()
    for q in (20, 40, 60, 80):
        vector = rows.where(F.col("vec_id") == q).first()["embedding"]
        single = [r["vec_id"] for r in search.top_k(rows, vector, 4, threshold=None, key="vec_id").collect()]
        assert [r["chunk_id"] for r in sorted(batch, key=lambda r: r["rank"]) if r["query_id"] == q] == single


def test_embeddings_come_in_batches_of_unit_length(spark):
    made = search.embed(spark.createDataFrame([("x",), ("y",), ("z",)], "t string").coalesce(1), "t", lambda some: [[3.0, 4.0]] * len(some), batch=2)
    assert [[round(x, 6) for x in r["embedding"]] for r in made.collect()] == [[0.6, 0.8]] * 3
    with pytest.raises(Exception, match="blank"):
        search.embed(spark.createDataFrame([(" ",)], "t string"), "t", lambda some: [[1.0]]).collect()


def test_only_new_contents_are_embedded_and_stale_ones_go(spark):
    old = spark.createDataFrame([("a", "a:1", "h1", [1.0]), ("a", "a:2", "h2", [2.0]), ("b", "b:1", "h1", [3.0])], "article_id string, chunk_id string, content_hash string, embedding array<double>")
    new = spark.createDataFrame([("a", "a:1", "h1"), ("a", "a:3", "h3")], "article_id string, chunk_id string, content_hash string")
    change = index.delta(old, new)
    assert [r["chunk_id"] for r in change.to_embed.collect()] == ["a:3"] and [r["embedding"] for r in change.reused.collect()] == [[1.0]]
    assert [r["chunk_id"] for r in change.to_delete.collect()] == ["a:2"]
    after = index.applied(old, change, change.to_embed.withColumn("embedding", F.array(F.lit(9.0))))
    assert sorted(r["chunk_id"] for r in after.collect()) == ["a:1", "a:3", "b:1"]


def test_versions_roll_back(spark, tmp_path):
    table = index.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert [table.write(spark.range(n)) for n in (3, 5)] == [1, 2] and table.read().count() == 5
    with pytest.raises(Exception):
        table.write(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")))
    assert table.read().count() == 5 and table.rollback() == 1 and table.read().count() == 3
    with pytest.raises(ValueError):
        table.rollback()


def test_integrity_classes(spark):
    rows = [("1", False, "x", "f", "t"), ("2", True, None, " ", "t"), ("3", True, "gone", None, "t"), ("4", True, "x", None, "not there"), ("5", True, "x", None, " body "), ("6", True, None, "f", "t")]
    found = spark.createDataFrame(rows, "chunk_id string, has_metadata boolean, article_id string, source_file string, text string")
    now = spark.createDataFrame([("x", "the body of x")], "id string, content string")
    checked = index.integrity(found, now)
    assert {r["chunk_id"]: r["problem"] for r in checked.collect()} == {"1": "empty_metadata", "2": "missing_both_fields", "3": "orphan", "4": "stale", "5": None, "6": None}
    assert index.report(checked).first().asDict() == {"total_chunks": 6, "empty_metadata": 1, "missing_both_fields": 1, "orphan": 1, "stale": 1}
    assert sorted(r["chunk_id"] for r in index.cleaned(found, checked).collect()) == ["4", "5", "6"]


def test_articles_change(spark):
    columns = "id string, document_id string, title string, content string, source_file string, created_at string, updated_at string"
    old = spark.createDataFrame([("1", "d1", "A", "a", "f", "t0", "t0"), ("2", "d2", "B_b", "b", "f", "t0", "t0")], columns)
    new = spark.createDataFrame([("9", "d1", "New", "n", "g", "t1", "t1"), ("3", "d3", "C", "c", "g", "t1", "t1")], columns)
    merged = {r["document_id"]: (r["id"], r["title"], r["created_at"], r["updated_at"]) for r in articles.upsert(old, new).collect()}
    assert merged == {"d1": ("1", "New", "t0", "t1"), "d2": ("2", "B_b", "t0", "t0"), "d3": ("3", "C", "t1", "t1")}
    with pytest.raises(articles.DuplicateDocumentError):
        articles.insert(old, new)
    assert [r["id"] for r in articles.list_page(old, search="b_B").collect()] == ["2"]
    page = articles.page_with_next(old, 0, 1).collect()
    assert [(r["id"], r["has_next"]) for r in page] == [("1", True)]


def test_answers_keep_valid_citations_in_order(spark):
    rows = spark.createDataFrame([("Yes [S2] and [S9] but [S1] or [S2].",), ("Nothing cited",), ("không có thông tin [S1]",)], "answer string").withColumn("chunks", F.array(F.lit("a"), F.lit("b")))
    got = {r["answer"][:3]: r for r in rag.answered(rows).collect()}
    assert got["Yes"]["sources"] == ["b", "a"] and got["Yes"]["cleaned"] == "Yes [S2] and but [S1] or [S2]." and got["Yes"]["no_answer_reason"] is None
    assert all(got[k]["sources"] == [] and got[k]["cleaned"] == rag.REFUSAL and got[k]["no_answer_reason"] == "insufficient_context" for k in ("Not", "khô"))


def test_history_is_cut_before_it_is_filtered(spark):
    rows = [(1, i, "system" if i % 2 else "user", f" m{i} ") for i in range(9)]
    kept = rag.history_window(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert sorted(r["text"] for r in kept.collect()) == ["m4", "m6", "m8"]


def test_case_sets(spark):
    good = [{"question": f" q{i}", "expected_source": "s"} for i in range(8)] + [{"question": "n", "expect_no_context": True}] * 2
    assert evaluation.validated_cases(good)[0]["question"] == "q0"
    for bad in (good[:9], [{"question": " "}, *good], [{"question": "x", "expected_source": "s", "expect_no_context": True}, *good], [{"question": "x", "expected_source": "s", "filters": {"title": "y"}}, *good]):
        with pytest.raises(ValueError):
            evaluation.validated_cases(bad)
    judged = spark.createDataFrame([(False, True, False), (False, True, True), (True, True, False)], "expect_no_context boolean, passed boolean, error boolean")
    assert evaluation.summary(judged).first().asDict() == {"cases": 3, "recall": 0.5, "no_context_accuracy": 1.0, "pass_rate": 2 / 3, "errors": 1}


def test_margins_that_repeat_go(spark):
    rows = [("d", p, float(y), 0.0, c) for p in range(1, 5) for y, c in ((0, "Header"), (5, f"body {p}"), (9, "Footer"))]
    kept = layout.repeated_margins(spark.createDataFrame(rows, "doc string, page int, y1 double, x1 double, content string"), "doc", "page")
    assert sorted(r["content"] for r in kept.collect()) == [f"body {p}" for p in range(1, 5)]


def test_pages_are_read_one_by_one(spark):
    """More pages than a batch has rows, some over its end; a null page is one too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if p == 3 else p, p * 10 + i, float(10 * (i % 2)), float(20 * i), 10.0 * (i % 2) + 8, 20.0 * i + 9) for p in range(12) for i in range(p % 5 + 1)]
        shapes = spark.createDataFrame(rows, "page int, shape_id int, y1 double, x1 double, y2 double, x2 double")
        got = layout.xy_cut(shapes, "page").collect()
        assert sorted(r["shape_id"] for r in got) == sorted(r[1] for r in rows)
        for p in range(12):
            own = sorted((r for r in got if r["shape_id"] // 10 == p), key=lambda r: r["position"])
            assert [r["position"] for r in own] == list(range(len(own)))
            assert [r["shape_id"] for r in own] == sorted((r["shape_id"] for r in own), key=lambda i: (i % 10 % 2, i))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_of_recognised_words(spark):
    grid = [("p", 2 * r + c, f"{'LR'[c]}{r}", 400.0 * c, 30.0 * r, 400.0 * c + 60, 30.0 * r + 10) for r in range(3) for c in range(2)]
    words = spark.createDataFrame(grid, "page string, word_id int, text string, x0 double, top double, x1 double, bottom double")
    assert [r["text"] for r in layout.regions(words, "page").orderBy("position").collect()] == ["L0", "L1", "L2", "R0", "R1", "R2"]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in parts.items():
            file.writestr(name.replace("_RELS_", "[rels]").replace("__", "/").replace("_DOT_", ".").replace("[rels]", "_rels"), text)
    return out.getvalue()


def docx():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    return zipped(word__document_DOT_xml=f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')


def test_office_files(spark):
    assert office.docx_to_markdown(docx(), "stem") == "# stem\n\n## Head\n\none two\n\n| a\\|b |\n| --- |"
    book = zipped(
        xl__workbook_DOT_xml='<w xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></w>',
        xl___RELS___workbook_DOT_xml_DOT_rels='<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>',
        xl__sharedStrings_DOT_xml="<s><si><t>na</t><t>me</t></si></s>",
        xl__worksheets__s_DOT_xml='<w><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>k</v></c><c><v>next</v></c></row><row r="2"/><row r="4"><c r="C4"><v>7</v></c></row></w>',
    )
    assert "xl/_rels/workbook.xml.rels" in zipfile.ZipFile(io.BytesIO(book)).namelist()
    assert office.xlsx_to_markdown(book, "b") == "# b\n\n## Sheet: S\n\n| name |  | k | next |\n| --- | --- | --- | --- |\n|  |  | 7 |  |"
    assert [office.column_index(x) for x in ("A1", "Z9", "AA3")] == [0, 25, 26]
    files = spark.createDataFrame([("d1", "f.docx", ".docx", bytearray(docx())), ("d2", "g.docx", ".docx", bytearray(b"broken")), ("d3", "h.pdf", ".pdf", bytearray(b"x"))], "document_id string, source_file string, ext string, content binary")
    rows = {r["document_id"]: r for r in office.to_markdown(files).collect()}
    assert rows["d1"]["markdown"].startswith("# f\n\n## Head") and rows["d2"]["error"].startswith("BadZipFile") and rows["d3"]["error"].startswith("ProviderMissing")


def deck():
    shape = lambda x, y, body, extra="": f'<p:sp><p:nvSpPr><p:nvPr>{extra}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="10" cy="10"/></a:xfrm></p:spPr><p:txBody>{body}</p:txBody></p:sp>'
    text = lambda x, level=0: f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{x}</a:t></a:r></a:p>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr name="Picture 3" descr=" A cat "/></p:nvPicPr><p:blipFill><a:blip r:embed="r2"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="60"/><a:ext cx="5" cy="5"/></a:xfrm></p:spPr></p:pic>'
    cells = "<a:tbl><a:tr><a:tc><a:p><a:r><a:t>a|b</a:t></a:r></a:p></a:tc><a:tc/></a:tr><a:tr><a:tc><a:p><a:r><a:t>1</a:t></a:r></a:p></a:tc></a:tr></a:tbl>"
    frame = f'<p:graphicFrame><p:xfrm><a:off x="0" y="40"/><a:ext cx="90" cy="9"/></p:xfrm>{cells}</p:graphicFrame>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="50" y="20"/><a:ext cx="30" cy="15"/></a:xfrm></p:grpSpPr>{shape(5, 9, text("in group 2"))}{shape(5, 1, text("in group 1"))}</p:grpSp>'
    tree = shape(0, 0, text("Title"), '<p:ph type="title"/>') + frame + group + picture + shape(0, 20, text("left") + text("deeper", 1) + text(" "))
    one = f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
    two = '<p:sld xmlns:p="p"><p:cSld><p:spTree/></p:cSld></p:sld>'
    rels = lambda **targets: "<R>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</R>"
    return zipped(
        ppt__presentation_DOT_xml='<p xmlns:r="r"><sldId r:id="s1"/><sldId r:id="s2"/></p>', ppt___RELS___presentation_DOT_xml_DOT_rels=rels(s1="slides/slide1.xml", s2="slides/slide2.xml"),
        ppt__slides__slide1_DOT_xml=one, ppt__slides__slide2_DOT_xml=two, ppt__slides___RELS___slide1_DOT_xml_DOT_rels=rels(r2="../media/i.PNG", n="../notesSlides/n1.xml"),
        ppt__media__i_DOT_PNG="bytes", ppt__notesSlides__n1_DOT_xml='<n xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="sldNum"/><a:p><a:t>1</a:t></a:p></p:sp><p:sp><a:p><a:t>say this</a:t></a:p><a:p><a:t>and that</a:t></a:p></p:sp></n>',
    )


def test_slides_have_tables_pictures_groups_and_levels(spark):
    want = ["---\ntitle: d.pptx\ntotal_slides: 2\n---", "## Title", "* left\n    * deeper", "* in group 1", "* in group 2", "| a\\|b |  |\n| --- | --- |\n| 1 |  |", "![A cat](slide_1_shape_6.png)", "> **Speaker Notes:**\n> say this\n> and that", "---", "## [Untitled Slide]", "---"]
    assert office.pptx_to_markdown(deck(), "d") == "\n\n".join(want)
    files = spark.createDataFrame([("d1", ".pptx", bytearray(deck())), ("d2", ".pptx", bytearray(b"x")), ("d3", ".docx", bytearray(docx()))], "document_id string, ext string, content binary")
    assert [tuple(r) for r in office.slide_pictures(files).collect()] == [("d1", "slide_1_shape_6.png", bytearray(b"bytes"))]


def test_many_stacked_shapes_are_cut():
    boxes = [(0.0, 2.0 * i, 1.0, 2.0 * i + 1) for i in range(3000)]
    assert office.cut_order(boxes, list(range(2999, -1, -1))) == list(range(3000))
    columns = [(2.0 * i, 0.0, 2.0 * i + 1, 5.0) for i in range(300)]
    assert office.cut_order(columns, list(range(299, -1, -1))) == list(range(300))


def test_files_that_arrive_become_chunks_once(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    for name in ("a.docx", "b.docx"):
        (source / name).write_bytes(docx())
        ingest.ingest_files(spark, str(source), str(target), str(checkpoint)).awaitTermination()
    rows = spark.read.parquet(str(target / "chunks")).collect()
    assert sorted((r["content"][:12], r["metadata"]["source_file"]) for r in rows) == [("## Head\n\none", "a.docx"), ("## Head\n\none", "b.docx")]


def test_logs_are_appended_and_counted(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    rows = [{"id": i, "question": "why so?", "answer": "x", "sources": [], "created_at": f"2024-01-01T00:0{i}:00Z"} for i in range(8)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    ingest.log_answers(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    logs = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["questions"] for r in ingest.question_rates(logs).collect()) == [3, 5]
