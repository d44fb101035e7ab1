"""Runnable queries by family; ``load()`` imports every family once."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

FAMILIES = ["ledger", "archive", "text", "statistics", "evaluation", "agentlogs", "graph", "survival", "retrieval", "similarity", "incremental"]


def load() -> SimpleNamespace:
    from attestry.plans import catalogue

    for family in FAMILIES:
        try:
            importlib.import_module(f"attestry.plans.{family}")
        except ModuleNotFoundError as e:
            if e.name != f"attestry.plans.{family}":
                raise
    return SimpleNamespace(queries=catalogue.QUERIES, check_sql=catalogue.CHECK_SQL, covers=catalogue.COVERS)
