"""The named queries and, where SQL can express them, their oracles. Each query applies an operator to whole tables."""

from __future__ import annotations

from . import blend_queries, density_queries, model_queries, noise_queries, score_queries, sorting_queries, spike_queries, unit_queries

MODULES = (spike_queries, unit_queries, density_queries, model_queries, noise_queries, score_queries, sorting_queries, blend_queries, model_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
