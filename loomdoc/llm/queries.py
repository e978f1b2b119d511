"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import html, infilling, lexical, licenses, media, mixing, packing, pii, quality, simhash, sql, tokenfile, toxicity, transducer
from loomdoc.llm.common import table
from loomdoc.llm.tokens import vocabulary_file


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.licence_scan("text").alias("found"))
    return found.select("doc_id", *[f"found.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _of(spans: str, *kinds: str):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _digest(spans: str, *kinds: str):
    """kind:start:end of the spans of these kinds (all without any), comma-joined."""
    chosen = _of(spans, *kinds) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(_of("spans", kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest("spans", *pii.KINDS), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_tokens(manifest)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.derive(media.store(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(documents, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), end_id=0, with_ids=False)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = transducer.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", infilling.fill_in_middle("doc_id", "text").alias("made"))
    digest = lambda text: F.sha2(text, 256)
    back = infilling.restored("made.output", "made.form")
    return made.select("doc_id", "made.n", "made.form", "made.prefix_chars", "made.middle_chars", digest(F.col("made.output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OPERATORS = (
    op1_license_scan, op2_personal_data, op3_simhash, op4_token_files, op5_quality, op6_main_text, op7_mixing, op8_media, op9_toxicity, op10_packing, op11_lexical_search, op12_bpe_transducer,
    op13_fill_in_middle,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
