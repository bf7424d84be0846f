"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from loomlog.catalog.registry import ORACLES, QUERIES

CHAPTERS = ["source", "sequence", "prefix", "curve", "join", "profile", "blend", "spatial", "model", "transfer", "align"]


def load() -> tuple[dict, dict]:
    for name in CHAPTERS:
        importlib.import_module(f"loomlog.catalog.{name}_queries")
    return QUERIES, ORACLES
