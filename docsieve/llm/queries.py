"""The registered queries of this subpackage and, where SQL can say the same, the statements that check them."""

from __future__ import annotations

from docsieve.llm import ann, exact_dedup, hard_negatives, jaccard, line_dedup, lm_score, mixing, near_dedup, pieces, sharding, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_nearest_neighbours": ann.op2,
    "op3_drop_repeated_passages": substring_dedup.op3,
    "op4_toxicity": toxicity.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_lm_scores": lm_score.op6,
    "op7_sentence_pieces": pieces.op7,
    "op8_mix_sources": mixing.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_byte_shards": sharding.op10,
    "op11_jaccard_join": jaccard.op11,
    "op12_whiten": whitening.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
