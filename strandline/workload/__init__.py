"""Queries over the driver's tables that exercise the engine's operators, each with its SQL twin."""

from . import artifact_queries, graph_queries, merge_queries, project_queries, relational_queries, scalar_queries

MODULES = (artifact_queries, project_queries, graph_queries, merge_queries, relational_queries, scalar_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracles() -> dict:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
