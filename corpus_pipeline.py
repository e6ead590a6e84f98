"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding of `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.

1. quality: rejects go; lines that too many documents of a source share go from the texts that stay.
2. near_dedup: one document of each group of near duplicates stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix: documents come as often as the mix of sources asks for, each once at least.
5. shard: each row gets a shard and a slot.

Null and wordless texts are rejected by the quality rules; null sources are a source. Of repeated rows and rows of one id, each is
judged by itself by stages 1, 3 and 4, and one of each group of near duplicates stays in stage 2 (that of the smallest id, ties by a
hash of the text). Very long texts are whole rows throughout. An empty table stays empty, and columns beyond those of `documents` go
along unchanged, whatever their names, but for `shard` and `slot` in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontaminate as decontamination
from cohortry.llm import mixing, near_dedup, quality, sharding
from cohortry.llm.base import saved, table


def _columns(df: DataFrame, names: list[str]) -> list:
    return [F.col(f"doc.`{c}`").alias(c) for c in names]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are common at their source; n_chars follows the text."""
    out = quality.quality(docs).where("kept")
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last)."""
    return near_dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than three quarters of each benchmark item's shingles; without a benchmark all of them."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for, once at least."""
    return mixing.mix(docs).select(*_columns(docs, docs.columns))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard (0 to 23, near equal in bytes) and slot, from an old layout by source; copies of a text share a shard."""
    out = sharding.with_shards(docs, old=sharding.shard_of_source() if "source" in docs.columns else None)
    return out.select(*_columns(docs, [c for c in docs.columns if c not in ("shard", "slot")]), "shard", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]
#: Hash sketches and hash orders aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
