"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, line_dedup, near_dedup, personal, quality, vector_codes, warc
from .base import table
from .decontaminate import contaminated
from .html_text import main_text
from .language import identify
from .mixing import mix
from .near_dedup import near_duplicates
from .sharding import reshard_files, shard_of_source

HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    return chat.digests(chat.read_chat(chat.format_chat(turns.union(hard))))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_files(table(spark, sf_dir, "documents"), old=shard_of_source())


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_minhash_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_distinct_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.length("clean").cast("long").alias("clean_chars"), F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "n_tokens", "epoch", "block", "position")


def op9_consensus_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_char_tagger_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "documents"))


def op12_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_adaptive_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_budgeted_chat_windows,
        op2_warc_transactions,
        op3_hyperminhash_near_dedup,
        op4_min_cost_flow_resharding,
        op5_language_mixture,
        op6_minhash_containment_decontamination,
        op7_distinct_site_lines,
        op8_temperature_mixing,
        op9_consensus_html_text,
        op10_line_frequency_quality,
        op11_char_tagger_personal_data,
        op12_perfect_hash_alignment,
        op13_adaptive_bound_codes,
    )
}
SQL: dict[str, str] = {
    "op2_warc_transactions": warc.SQL,
    "op3_hyperminhash_near_dedup": near_dedup.SQL,
    "op6_minhash_containment_decontamination": decontaminate.SQL,
    "op7_distinct_site_lines": line_dedup.SQL,
    "op10_line_frequency_quality": quality.SQL,
    "op13_adaptive_bound_codes": vector_codes.SQL,
}
