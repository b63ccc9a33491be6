"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, language, minhash, quotes, secrets, sentencepiece_fst, substring, token_ids, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embeddings.op1_embedding_dedup,
        "op2_sentencepiece": sentencepiece_fst.op2_sentencepiece,
        "op3_language_id": language.op3_language_id,
        "op7_minhash": minhash.op7_minhash,
        "op8_toxicity": toxicity.op8_toxicity,
        "op10_token_ids": token_ids.op10_token_ids,
        "op4_quotation_linking": quotes.op4_quotation_linking,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op9_secret_scans": secrets.op9_secret_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embeddings.SQL,
        "op5_substring_dedup": substring.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op7_minhash": minhash.SQL,
        "op9_secret_scans": secrets.SQL,
    }
