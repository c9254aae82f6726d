"""Registered queries: each group has QUERIES (callables of session and folder) and SQL for the same rows."""

from tidemark.plans import inference, relational, studies, timeseries, tpch, vectors

GROUPS = (relational, vectors, tpch, studies, timeseries, inference)


def queries() -> dict:
    return {name: query for g in GROUPS for name, query in g.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for g in GROUPS for name, text in g.SQL.items()}
