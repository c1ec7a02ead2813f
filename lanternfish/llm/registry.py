"""The operators' queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from . import html_text, mixing, near_dedup, quality_knn, quality_rules, sentencepiece_codec, substring_dedup, token_counts, topk_search, url_filter

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality_knn": quality_knn.query,
    "op3_near_dedup": near_dedup.query,
    "op4_token_counts": token_counts.query,
    "op5_url_filter": url_filter.query,
    "op6_sentencepiece": sentencepiece_codec.query,
    "op7_html_text": html_text.query,
    "op8_topk_search": topk_search.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op3_near_dedup": near_dedup.ORACLE_SQL,
    "op8_topk_search": topk_search.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
}
