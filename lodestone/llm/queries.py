"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, chat, divergence, langid, licenses, line_dedup, merkle, minhash, packing, quality, suffix_dedup, syncmers, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": syncmers.op1_document_fingerprints,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op2_token_packing": packing.op2_token_packing,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op7_language_id": langid.op7_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op8_quality_outliers": quality.op8_quality_outliers,
    "op4_license_scan": licenses.op4_license_scan,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_suffix_array_dedup": suffix_dedup.op13_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
