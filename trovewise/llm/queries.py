"""The ten operators as registered queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, chat, decontaminate, line_dedup, near_dedup, packing, quality, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "keep")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.as_binary(packing.pack(_table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(_table(spark, sf_dir, "conversations"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexity(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "token_files": token_files,
    "op9_chat_format": op9_chat_format,
    "op10_perplexity": op10_perplexity,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality": quality.oracle(),
    "op9_chat_format": chat.oracle(),
}
