"""Registered queries of the training-data operators."""

from __future__ import annotations

from motionframe.llm import best_fit_packing, conversation_repair, embedding_dedup, html_extraction, license_scan, metric_tree, minhash, piece_lattice, prefix_trie, quality_classifier, quality_rules, token_matrix, url_filter

_MODULES = (quality_rules, quality_classifier, minhash, best_fit_packing, token_matrix, license_scan, url_filter, html_extraction, metric_tree, piece_lattice, conversation_repair, embedding_dedup, prefix_trie)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
