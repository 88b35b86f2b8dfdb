"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe_queries, edit_embedding, minhash, ngram_trie, packing, pii, quality_pu, quality_rules, token_counts, toxicity

QUERIES = {
    "op10_minmax_hash": minhash.query,
    "op1_token_counts": token_counts.query,
    "op2_best_two_fit": packing.query,
    "op3_ngram_trie": ngram_trie.query,
    "op4_pii_boosting": pii.query,
    "op5_quality_rules": quality_rules.query,
    "op6_toxicity": toxicity.query,
    "op7_bpe": bpe_queries.query,
    "op8_edit_embedding": edit_embedding.query,
    "op9_quality_pu": quality_pu.query,
}

ORACLES: dict[str, str] = {"op10_minmax_hash": minhash.SQL}
