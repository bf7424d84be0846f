"""The registered queries of the numbered operators."""

from __future__ import annotations

import importlib

from loomlog.llm.documents import ORACLES, QUERIES

OPERATORS = ["fingerprints", "contamination", "language_model", "near_duplicates", "pages", "urls", "token_files", "personal_data", "toxicity", "bpe", "packing", "search", "prefix_trie"]


def load() -> tuple[dict, dict]:
    for name in OPERATORS:
        importlib.import_module(f"loomlog.llm.{name}")
    return QUERIES, ORACLES
