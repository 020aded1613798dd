"""Citation graphs as edge lists (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which the tables of reached nodes become one.
COMPACT = 16


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): distinct nodes one step away from ``nodes`` (id), in either direction."""
    out = edges.join(nodes, edges["src"] == nodes["id"], "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(nodes, edges["dst"] == nodes["id"], "left_semi").select(F.col("src").alias("id"))
    return out.union(back).distinct()


def expand(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(id): the frontier after so many rounds; each round replaces it, seeds aren't kept."""
    now = seeds.select("id").distinct()
    for _ in range(rounds):
        now = neighbours(edges, now).checkpoint()
    return now


def expand_to(edges: DataFrame, seeds: DataFrame, size: int | None = None) -> DataFrame:
    """(id): everything reached, until nothing is new or there are ``size`` nodes, however many rounds that takes.

    Only new nodes are expanded. Each round writes its new nodes; what was written before is rewritten as one table
    every COMPACT rounds only.
    """
    fresh = seeds.select("id").distinct().checkpoint()
    seen, parts, total = fresh, 1, fresh.count()
    while size is None or total < size:
        fresh = neighbours(edges, fresh).join(seen, "id", "left_anti").checkpoint()
        new = fresh.count()
        if not new:
            break
        seen, parts, total = seen.union(fresh), parts + 1, total + new
        if parts == COMPACT:
            seen, parts = seen.checkpoint(), 1
    return seen


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, n): how many edges end in each node."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def within_size(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    left = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return left.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
