"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from driftgrid.llm import packing, pieces, pii, quality, sharding, simhash, stages, substrings, tokens, topk, urls

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_shard": sharding.op2_shard,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_pack": packing.op6_pack,
    "op7_top_k": topk.op7_top_k,
    "op8_url_filter": urls.op8_url_filter,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "pipeline": stages.run,
}

ORACLES = {
    "op7_top_k": topk.oracle(),
    "op8_url_filter": urls.oracle(),
    "op10_quality_rules": quality.oracle(),
}
