"""The registered queries of the corpus operators: one for each, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vintage_jobs.llm import alignment, chat, codes, counting, ctph, decontam, html_text, langid, packing, pii, quality, simhash, substring
from vintage_jobs.llm.common import table


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.message_events(rows.unionByName(chat.control_conversation(spark))))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_neighbours(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_digest(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_pii": op6_pii,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_langid": op9_langid,
    "op10_ctph": op10_ctph,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op2_decontamination": decontam.ORACLE, "op5_substring": substring.ORACLE, "op8_chat": chat.ORACLE, "op13_vector_codes": codes.oracle()}
