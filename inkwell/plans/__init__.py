"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import graphs, relations, searching, texts, vectors

PARTS = (texts, relations, searching, vectors, graphs)


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: q[0] for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL for the same rows; queries that SQL can't express have none."""
    return {name: q[1] for part in PARTS for name, q in part.QUERIES.items() if q[1]}
