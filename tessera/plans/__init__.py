"""Queries by family; importing this package registers them."""

from tessera.plans import answerable, facts, flows, items, reports, resampling, selection, solvers, statistics, templates, texts, variants
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answerable", "facts", "flows", "items", "reports", "resampling", "selection", "solvers", "statistics", "templates", "texts", "variants"]
