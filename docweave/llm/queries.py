"""The registered queries of this subpackage and, where SQL can express them, their SQL."""
from __future__ import annotations

from . import bpe, filter_audit, merkle, minhash, mixture, ngram_join, pii, quality, ring_shards, substring_dedup, suffix_dedup, token_files, topk_search

QUERIES = {
    "op1_additive_quality": quality.op1_additive_quality,
    "op2_bpe_segment_tree": bpe.op2_bpe_segment_tree,
    "op3_bit_packed_tokens": token_files.op3_bit_packed_tokens,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_seed_extend_repeats": substring_dedup.op5_seed_extend_repeats,
    "op6_ring_bounded_loads": ring_shards.op6_ring_bounded_loads,
    "op7_minhash_fingerprints": minhash.op7_minhash_fingerprints,
    "op8_histogram_top_k": topk_search.op8_histogram_top_k,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_sainte_lague_mix": mixture.op10_sainte_lague_mix,
    "op11_wide_counters": filter_audit.op11_wide_counters,
    "op12_incremental_witnesses": merkle.op12_incremental_witnesses,
    "op13_lcp_merge_sort": suffix_dedup.op13_lcp_merge_sort,
}
ORACLE = {**topk_search.ORACLE, **filter_audit.ORACLE, **merkle.ORACLE}
