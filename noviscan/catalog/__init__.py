"""All registered queries and their SQL counterparts."""

import importlib

from noviscan.catalog.base import ORACLE, QUERIES

MODULES = ("novelty", "sources", "notes", "text", "topics", "drafts", "runs", "streams")

for _name in MODULES:
    importlib.import_module(f"noviscan.catalog.{_name}")

__all__ = ["ORACLE", "QUERIES"]
