"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from cyclewise.llm import (
    op1_jaccard_join, op2_quality_rules, op3_html, op4_mixing, op5_topk, op6_substring_dedup, op7_url_filter,
    op8_packing, op9_sharding, op10_token_blocks, op11_runs, op12_chat, op13_manifest,
)

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join.query,
    "op2_quality_rules": op2_quality_rules.query,
    "op3_html": op3_html.query,
    "op4_mixing": op4_mixing.query,
    "op5_topk": op5_topk.query,
    "op6_substring_dedup": op6_substring_dedup.query,
    "op7_url_filter": op7_url_filter.query,
    "url_rules": op7_url_filter.rules_query,
    "op8_packing": op8_packing.query,
    "op9_sharding": op9_sharding.query,
    "op10_token_blocks": op10_token_blocks.query,
    "op11_runs": op11_runs.query,
    "op12_chat": op12_chat.query,
    "op13_manifest": op13_manifest.query,
}
ORACLE = {
    "op2_quality_rules": op2_quality_rules.ORACLE_SQL,
    "op5_topk": op5_topk.ORACLE_SQL,
    "op6_substring_dedup": op6_substring_dedup.ORACLE_SQL,
    "url_rules": op7_url_filter.RULES_SQL,
    "op12_chat": op12_chat.ORACLE_SQL,
    "op13_manifest": op13_manifest.ORACLE_SQL,
}
