"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, langid, lm, mixing, near_dedup, substring_dedup, url_filter

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_lm_score": lm.op3_lm_score,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_chat": chat.op8_chat,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op2_url_filter": url_filter.SQL,
    "op4_mix_sources": mixing.SQL,
    "op8_chat": chat.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
