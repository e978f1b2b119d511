"""What held on small tables only: ranges that are planned twice, marks that a text has by itself."""

from pyspark.sql import functions as F

from loomdoc.operators import articles, pages


def test_ids_of_a_log_go_on_whatever_the_ranges_are(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(4000).select(F.col("id").alias("n"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 9).cast("string"), 512)).alias("question"))
        log = rows.limit(0).select(F.lit(0).cast("long").alias("id"), "question")
        got = articles.appended(articles.appended(log, rows.where("n < 2500"), ["n"]), rows.where("n >= 2500"), ["n"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {r["question"]: r["n"] + 1 for r in rows.collect()}
    assert len(got) == 4000 and all(want[r["question"]] == r["id"] for r in got)


def test_lines_go_on_by_what_the_reader_knows_of_items(spark):
    lines = spark.createDataFrame([("a", i, x, False, float(i)) for i, x in enumerate(["10.2.0.1 is where", "it stands", "- item", "more"])], "doc string, line int, text string, heading boolean, top double")
    found = lambda **item: [r["text"] for r in pages.continued(lines, ["doc"], **item).orderBy("line").collect()]
    assert found(item=F.col("line") == 2) == ["10.2.0.1 is where it stands", "- item", "more"]
    assert found() == ["10.2.0.1 is where", "it stands", "- item", "more"]


def test_continued_lines_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from loomdoc.plans import catalogue

    texts = ["96.1.2.3 begins\nand goes on\n3) here", "a\nb\nc\nd\n\ttabbed item \nf\n\t\ng\nh\n\t \nend", "\t\n\n", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalogue.queries()["continued_lines"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(catalogue.oracle_sql()["continued_lines"]).fetchall())
