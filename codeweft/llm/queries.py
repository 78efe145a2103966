"""Queries of the operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from codeweft.llm import (
    divergence,
    exact_dedup,
    jaccard_join,
    language_id,
    packing,
    phrases,
    secrets,
    sharding,
    suffix_index,
    token_files,
    tokenizing,
    topk,
    toxicity,
)

QUERIES = {
    "op1_language_bitmask": language_id.op1_language_bitmask,
    "op2_minimax_shards": sharding.op2_minimax_shards,
    "op3_secret_ledger": secrets.op3_secret_ledger,
    "op4_signature_tree_join": jaccard_join.op4_signature_tree_join,
    "op5_tiered_packing": packing.op5_tiered_packing,
    "op6_suffix_family": suffix_index.op6_suffix_family,
    "op7_norm_bucket_topk": topk.op7_norm_bucket_topk,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_bpe_automaton": tokenizing.op9_bpe_automaton,
    "op10_toxicity_neighbours": toxicity.op10_toxicity_neighbours,
    "op11_row_accumulation": divergence.op11_row_accumulation,
    "op12_elias_fano_files": token_files.op12_elias_fano_files,
    "op13_toivonen_phrases": phrases.op13_toivonen_phrases,
}

ORACLES = {
    "op3_secret_ledger": secrets.SQL,
    "op7_norm_bucket_topk": topk.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_row_accumulation": divergence.SQL,
    "op13_toivonen_phrases": phrases.SQL,
}
