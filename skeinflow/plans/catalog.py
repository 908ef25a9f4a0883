"""Registry of the queries of the core library and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core_problems", "flow_queries", "eval_queries", "text_queries", "graph_queries", "label_queries", "stream_queries", "model_queries", "extra_queries", "store_queries", "audit_queries", "training_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"skeinflow.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"skeinflow.plans.{m}").ORACLE.items()}
