"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from gigmatch.llm import (
    alignment,
    exact_dedup,
    hilbert,
    language,
    minhash,
    mixing,
    neighbours,
    packing,
    phrases,
    quality,
    secrets,
    simhash,
    token_counts,
)

QUERIES = {
    "op1_crf_quality": quality.op1_crf_quality,
    "op2_learned_partition_search": neighbours.op2_learned_partition_search,
    "op3_longest_match_token_counts": token_counts.op3_longest_match_token_counts,
    "op4_bloom_language_id": language.op4_bloom_language_id,
    "op5_hilbert_sharding": hilbert.op5_hilbert_sharding,
    "op6_golay_simhash": simhash.op6_golay_simhash,
    "op7_streaming_exact_dedup": exact_dedup.op7_streaming_exact_dedup,
    "op8_soft_membership_mixing": mixing.op8_soft_membership_mixing,
    "op9_trigram_secret_scan": secrets.op9_trigram_secret_scan,
    "op10_pattern_packing": packing.op10_pattern_packing,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_fm_index_phrases": phrases.op12_fm_index_phrases,
    "op13_fast_sketch_minhash": minhash.op13_fast_sketch_minhash,
}
SQL = {
    "op7_streaming_exact_dedup": exact_dedup.SQL,
    "op9_trigram_secret_scan": secrets.SQL,
    "op12_fm_index_phrases": phrases.SQL,
    "op13_fast_sketch_minhash": minhash.SQL,
}
