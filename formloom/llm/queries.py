"""The operators' queries and their SQL."""

from __future__ import annotations

from formloom.llm import byte_bpe, importance, language, line_rules, near_text, near_vectors, ngram_lm, packing, pairwise, pii, prefix_trie, token_file, toxicity

MODULES = (byte_bpe, importance, language, line_rules, near_text, near_vectors, ngram_lm, packing, pairwise, pii, prefix_trie, token_file, toxicity)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
