"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from loomgraph.plans import queries_code, queries_graph, queries_tables

MODULES = [queries_graph, queries_tables, queries_code]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
