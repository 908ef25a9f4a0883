"""Registry of this subpackage's queries and their DuckDB twins."""

from __future__ import annotations

from skeinflow.llm import problem1, problem2, problem6, problem7, problem8, problem9

MODULES = (problem1, problem2, problem6, problem7, problem8, problem9)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
