"""Operators for preparing language-model training data, each with one registered query over the given tables."""

import importlib

from noviscan.llm.base import ORACLE, QUERIES

MODULES = (
    "decontamination", "sanitise", "language_id", "byte_bpe", "line_dedup", "html_consensus", "topk_search",
    "warc_revisit", "token_orc", "jaccard_join", "prefix_trie",
    "token_alignment", "best_fit",
)

for _name in MODULES:
    importlib.import_module(f"noviscan.llm.{_name}")

__all__ = ["ORACLE", "QUERIES"]
