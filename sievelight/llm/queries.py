"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import chat, language_id, media, mixing, ngram_join, packing, quality_model, quality_rules, sql, suffix_dedup, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": media.op1_media,
        "op2_token_files": token_files.op2_token_files,
        "op3_chat": chat.op3_chat,
        "op4_mixing": mixing.op4_mixing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_packing": packing.op6_packing,
        "op7_language_id": language_id.op7_language_id,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op5_ngram_join": sql.OP5_SQL, "op8_suffix_dedup": sql.OP8_SQL}
