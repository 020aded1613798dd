"""Markov transitions of state sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def transition_counts(rows: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """(prev, cur, cnt) over all sequences, each from START to END. A sequence without rows gives nothing.

    One sort by key; counts are pre-aggregated in tasks.
    """
    w = Window.partitionBy(key).orderBy(*order)
    pairs = rows.select(F.coalesce(F.lag(state).over(w), F.lit(K.START)).alias("prev"), F.col(state).alias("cur"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    steps = F.when(F.col("last"), F.array(F.struct("prev", "cur"), F.struct(F.col("cur").alias("prev"), F.lit(K.END).alias("cur")))).otherwise(F.array(F.struct("prev", "cur")))
    return pairs.select(F.explode(steps).alias("s")).groupBy("s.prev", "s.cur").agg(F.count("*").alias("cnt"))


def array_transitions(rows: DataFrame, states: str) -> DataFrame:
    """Transitions of sequences held as arrays; no sort is needed."""
    full = F.concat(F.array(F.lit(K.START)), F.col(states), F.array(F.lit(K.END)))
    steps = F.transform(F.sequence(F.lit(1), F.size(states) + 1), lambda i: F.struct(F.element_at(full, i).alias("prev"), F.element_at(full, i + 1).alias("cur")))
    return rows.where(F.size(states) > 0).select(F.explode(steps).alias("s")).groupBy("s.prev", "s.cur").agg(F.count("*").alias("cnt"))


def normalized(counts: DataFrame) -> DataFrame:
    """(prev, cur, p): counts by their state's sum."""
    total = counts.groupBy("prev").agg(F.sum("cnt").alias("t"))
    return counts.join(total, "prev").select("prev", "cur", (F.col("cnt") / F.col("t")).alias("p"))


def merged(*tables: DataFrame) -> DataFrame:
    """Sum of several transition tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("prev", "cur").agg(F.sum("cnt").alias("cnt"))
