"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderstream.llm import chats, fingerprints, language, metric, near, packing, pieces, private, quality, repeats, resampling, weighting, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_chat_formatting": chats.query,
    "op3_document_fingerprints": fingerprints.query,
    "op4_pii": private.query,
    "op5_suffix_array_dedup": repeats.query,
    "op6_language_id": language.query,
    "op7_sentencepiece": pieces.query,
    "op8_lm_scoring": weighting.query,
    "op9_minhash_near_dedup": near.query,
    "op10_packing": packing.query,
    "op11_embedding_whitening": whitening.query,
    "op12_ngram_jaccard_join": metric.query,
    "op13_importance_resampling": resampling.query,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.sql(),
    "op2_chat_formatting": chats.SQL,
    "op9_minhash_near_dedup": near.SQL,
    "op12_ngram_jaccard_join": metric.SQL,
    "op13_importance_resampling": resampling.SQL,
}
