"""Copies of a row are dealt over the groups of the packing like other rows."""

from collections import Counter

from loomdoc.llm import packing
from loomdoc.llm.tokens import vocabulary_file


def test_equal_rows_are_dealt_over_the_groups(spark):
    docs = spark.range(2000).selectExpr("1L AS doc_id", "'one text in many copies' AS text").repartition(5)
    rows = packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), 0, group=100, with_ids=False).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 2000 and len(groups) == 20 and max(groups.values()) < 200
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
