"""All queries of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from . import context_plans, evidence_plans, graph_plans, inventory_plans, lexical_plans, retrieval_plans, store_plans, task_plans

_GROUPS = [lexical_plans, graph_plans, retrieval_plans, evidence_plans, context_plans, inventory_plans, store_plans, task_plans]
QUERIES = {name: run for group in _GROUPS for name, run in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
