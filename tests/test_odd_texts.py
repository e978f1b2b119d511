"""Queries on texts that the given tables don't have: the rows are those of the SQL."""

import duckdb

from loomdoc.plans import catalogue


def rows_of_both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of (key, text), whose other columns are made here."""
    con = duckdb.connect()
    for table, texts in tables.items():
        key = "item_id" if table == "benchmark" else "doc_id"
        made = spark.createDataFrame([(i, x, f"s{i % 3}") for i, x in enumerate(texts)], f"{key} long, text string, source string")
        made.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = catalogue.queries()[name](spark, str(folder))
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_keywords_stand_in_questions_by_lower_case_alone(spark, tmp_path):
    texts = ["Messe assen grosse", "Kelvin İstanbul", "ﬁnden finden ſtill still", "gross strasse", None, ""]
    asked = ["Die Meße, große Straße, aßen", "\u212aELVIN in İstanbul", "ﬁnden wir", "Gross\u2028Strasse", None, ""]
    for name in ("keyword_retrieval", "retrieval_eval"):
        got, want = rows_of_both(spark, tmp_path / name, name, documents=texts, benchmark=asked)
        assert got == want


BLANKS = ["", " ", "\n", "\t", "One. Two! Three?  Four", "Ends. Goes on.\u000bAnd on. \u000bLast. ", " \tBegins. \n Ends? \r\n", "A.\x01 B. \x01C\x01\x01d", ".\r\n\r\n! ? x", None]


def test_sentences_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    got, want = rows_of_both(spark, tmp_path, "sentence_split", documents=BLANKS)
    assert got == want and {r[0] for r in got} == {4, 5, 6, 7, 8}


LINES = ["", " ", "\n\n \n", " \n　", "\t", " \nfoo\n\n", "\nfoo \n  \n", "one ", "a\n\nb \n- c\n2. d", "a\r\nb\r\n", "x y\n \n\tz\u000b\n\t\n*", "- a\u0085- b\n\x1c1. c", "|a|\n  \n\n|b|\x01", None]


def test_list_items_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    got, want = rows_of_both(spark, tmp_path, "list_items", documents=LINES)
    assert got == want and {r[0] for r in got} == {4, 5, 6, 7, 8, 9, 10, 11, 12}
