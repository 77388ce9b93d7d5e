"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from lexispark.llm import bpe, decontaminate, html_text, jaccard, langid, substring, token_store, toxicity, vectors, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard.query,
        "op2_warc_revisits": warc.query,
        "op3_language_id": langid.query,
        "op4_token_id_output": token_store.query,
        "op5_byte_bpe": bpe.query,
        "op6_benchmark_decontamination": decontaminate.query,
        "op7_toxicity": toxicity.query,
        "op8_html_extraction": html_text.query,
        "op9_embedding_near_dedup": vectors.query,
        "op10_substring_dedup": substring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc.ORACLE}
