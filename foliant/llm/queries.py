"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, audio, codes, decontaminate, language, near, packing, periods, pii, quality, repeats, sharding, tokens
from .tables import table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(table(spark, sf_dir, "pages"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_texts(table(spark, sf_dir, "documents"))


def op3_hash_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_multi_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op12_bitmask_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.document_runs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_arc_to_warc, op2_mpeg_audio, op3_hash_suffix_sort, op4_multi_match_join, op5_weak_supervision_pii, op6_bradley_terry, op7_byte_shards,
        op8_ffd_packing, op9_language_id, op10_prefix_decontamination, op11_token_counts, op12_bitmask_codes, op13_periodic_runs,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": archives.ORACLE,
        "op4_multi_match_join": near.ORACLE,
        "op7_byte_shards": sharding.ORACLE,
        "op10_prefix_decontamination": decontaminate.ORACLE,
        "op12_bitmask_codes": codes.ORACLE,
        "op13_periodic_runs": periods.ORACLE,
    }
