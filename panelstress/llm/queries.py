"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstress.llm import (
    byte_bpe,
    dart_minhash,
    filter_audit,
    language_id,
    line_dedup,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    templates,
    toxicity,
    url_filters,
)
from panelstress.llm.common import bounded_batches, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(bounded_batches(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_line_dedup", line_dedup.OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), removed_col="n_removed")
    return rows.select("doc_id", "text", "n_removed")


#: The query has to give the same rows every time; a real run brings a secret key.
DEMONSTRATION_KEY = b"not a secret"


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced, and their number."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(documents, key=DEMONSTRATION_KEY, count_col="n_replaced")


@query("op3_quality_rules", quality_rules.OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "failed_rules",
    )


@query("op4_template_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    rows = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "n_found", "n_windows", "changed")


@query("op5_dart_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: class_id is the smallest doc_id of its class, kept marks the document that stays."""
    rows = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(rows["_id"].alias("doc_id"), "class_id", "kept")


def bpe_ranks() -> dict[bytes, int]:
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), bpe_ranks(), public_tokenizers.PATTERN)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, lexicon).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_hits", "weight", "n_words")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    vectors = quality_classifier.word_vectors(documents)
    network = quality_classifier.learn(documents, table(spark, sf_dir, "labels"), vectors)
    scored = quality_classifier.score(documents, vectors, network)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.learn(documents, list(bpe_ranks()))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return language_id.predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_url_filters", url_filters.OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.listed_domains(pages))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic_runs.with_planted_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(texts))


@query("op12_kd_shards")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op13_filter_interactions", filter_audit.OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks, filter_audit.FILTERS)
