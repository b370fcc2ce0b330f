"""The queries of this subpackage, by name: each takes (spark, sf_dir) and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideway.llm import chat, decontaminate, html_wrapper, jpeg, langid, mixing, neardup, repeats, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(sharding.measured(table(spark, sf_dir, "documents")))


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.stored(table(spark, sf_dir, "documents")))


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_prob_minhash": op1_prob_minhash,
        "op2_warc_normaliser": op2_warc_normaliser,
        "op3_jpeg_media": op3_jpeg_media,
        "op4_cgk_decontamination": op4_cgk_decontamination,
        "op5_chat_segments": op5_chat_segments,
        "op6_ecoc_language_id": op6_ecoc_language_id,
        "op7_repeated_spans": op7_repeated_spans,
        "op8_feistel_sharding": op8_feistel_sharding,
        "op9_soft_mixing": op9_soft_mixing,
        "op10_wrapper_induction": op10_wrapper_induction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_normaliser": warc.ORACLE,
        "op5_chat_segments": chat.oracle(),
    }
