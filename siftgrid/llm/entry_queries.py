"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from siftgrid.llm import ann_ivfpq, chat_format, html_wrapper, langid_ftrl, lm_hpy, merkle, mixing, ngram_join, packing, quality_iforest, simhash_dedup, spelling, token_counts


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_html_extraction": html_wrapper.op2_html_extraction,
        "op3_ann": ann_ivfpq.op3_ann,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_language_id": langid_ftrl.op5_language_id,
        "op6_packing": packing.op6_packing,
        "op7_simhash": simhash_dedup.op7_simhash,
        "op8_quality": quality_iforest.op8_quality,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_lm_scores": lm_hpy.op10_lm_scores,
        "op11_merkle": merkle.op11_merkle,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict:
    return {
        "op9_chat_format": chat_format.OP9_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
