"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hookloom.llm import codes, decontaminate, html, licences, mixing, pii, quality, sharding, simhash, trie, urls, warc, winnowing


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharding_report(_table(spark, sf, "documents"), shards=8)


def op2_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf, "pages"))


def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_report(_table(spark, sf, "pages"))


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf, "documents"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf, "documents"))


def op6_warc_capture_index(spark: SparkSession, sf: str) -> DataFrame:
    return warc.warc_report(_table(spark, sf, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf, "documents"))


def op8_soft_membership_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_licence_scans(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_report(_table(spark, sf, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op11_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.fingerprint_report(_table(spark, sf, "documents"))


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.trie_report(_table(spark, sf, "conversations"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.code_report(_table(spark, sf, "embeddings"))


_QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_sharding, op2_url_filters, op3_html_extraction, op4_personal_data, op5_quality_rules,
    op6_warc_capture_index, op7_simhash_near_dedup, op8_soft_membership_mixing, op9_licence_scans, op10_benchmark_decontamination,
    op11_document_fingerprints, op12_conversation_trie, op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": urls.OP2_SQL, "op9_licence_scans": licences.OP9_SQL, "op12_conversation_trie": trie.OP12_SQL,
        "op13_vector_codes": codes.OP13_SQL,
    }
