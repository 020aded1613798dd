"""Mixing sources to target weights: hierarchical budgets and seeded token-prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS = ("domain", "lang", "source")
DOMAINS = 4


def with_leaf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Columns to carry and tree columns: source, lang (null: '') and the domain, a fixed grouping of sources by the first byte of their MD5."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    domain = F.conv(F.substring(F.md5(text("source")), 1, 2), 16, 10).cast("int") % DOMAINS
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit("d"), domain.cast("string")).alias("domain"),
        text("lang").alias("lang"), text("source").alias("source"), tokens.alias("tokens"), *carry)


def _weigh(nodes: DataFrame, level: str, weights: dict[str, int], default: int) -> DataFrame:
    weight = F.lit(default)
    if weights:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), weight)
    return nodes.withColumn("w", weight.cast("double"))


def share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by weight ``w``, none above its capacity ``cap``.

    What a child can't take goes to its siblings by weight. Sorted by cap / w, a prefix of the children is full;
    the others share what is left. Window functions over siblings: one pass, no iteration. A child of weight zero
    gets nothing. Adds ``share``; drops ``budget``.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.coalesce(F.try_divide("cap", "w"), F.lit(float("inf")))
    order = by.orderBy(ratio, level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = (nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
          .withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("left_w", F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level_at = F.when((F.col("w") > 0) & (F.col("left_w") > 0), F.col("left_b") / F.col("left_w"))
    df = df.withColumn("open", F.when(level_at < ratio, level_at))
    df = df.withColumn("rate", F.min(F.when(F.col("open").isNotNull(), F.struct(ratio.alias("ratio"), level, "open"))).over(by)["open"])
    share = F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.greatest("rate", F.lit(0.0))))
    return df.withColumn("share", share).drop("left_b", "left_w", "open", "rate", "budget")


def leaf_budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: dict[str, dict[str, int]], default: int = 1) -> DataFrame:
    """Budget in tokens for each (domain, lang, source) leaf of ``leaves``, which has ``tokens`` for each.

    The root's budget is ``fraction`` of all tokens. Going down, a node never gets more than its subtree can give
    (tokens times ``max_epochs``), and its shortage goes to its siblings; only when all of them are full too has the
    level above already moved the budget elsewhere. So shortages are met among siblings before ancestors' siblings.
    """
    now = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).cast("double").alias("leaf_cap"))
    above, path = None, []
    root = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(fraction)) + 1e-6).cast("double")
    for level in LEVELS:
        nodes = now.groupBy(*path, level).agg(F.sum("leaf_cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("budget", root) if above is None else nodes.join(above, path)
        shared = share_out(_weigh(nodes, level, weights.get(level, {}), default), path, level)
        path = [*path, level]
        above = materialize(shared.select(*path, F.col("share").alias("budget")))  # a row for each node: keeps plans small
    return above.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], fraction: float = 1.0, max_epochs: int = 3, seed: int = 7,
        hex_digits: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies): how often each document is used; zero where it isn't.

    A leaf with budget b and t tokens gives b div t whole epochs and, of the next epoch, the documents in order of
    md5(seed:epoch:doc_id) while their running token sum is at most what is left. The order is cut into
    16**hex_digits ranges by the leading digits: range sums find the one range where the prefix ends, and only its
    rows are sorted, so a leaf with a third of all rows never meets in one task. Texts without tokens cost nothing
    and follow their place in the order. Null lang or source counts as ''. Repeated rows are separate documents with
    equal keys: they are used together or not at all. An empty table gives an empty table. The columns ``carry`` of
    ``docs`` come last; they must not have the names of others.
    """
    rows = materialize(with_leaf(docs, id_col, text_col, carry))  # texts are read and counted once
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    plan = leaf_budgets(leaves, fraction, max_epochs, weights).join(leaves.withColumnRenamed("tokens", "leaf_tokens"), list(LEVELS))
    full = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(F.lit(0)).cast("long")
    plan = materialize(plan.withColumn("epochs", full).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranked = rows.join(plan.select(*LEVELS, "epochs", "rest"), list(LEVELS)).withColumn("ord", key)
    ranked = ranked.withColumn("span", F.substring("ord", 1, hex_digits))
    sums = ranked.groupBy(*LEVELS, "rest", "span").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("span"))
    sums = sums.select(*LEVELS, "span", (F.col("rest") - (upto - F.col("t"))).alias("room"), "t")
    state = F.when(F.col("room") >= F.col("t"), 2).when(F.col("room") >= 0, 1).otherwise(0)
    placed = ranked.join(sums.select(*LEVELS, "span", "room", state.alias("state")), [*LEVELS, "span"])
    out = [*LEVELS, "doc_id", "tokens", "epochs", *carry]
    whole = placed.where("state <> 1").select(*out, F.when(F.col("state") == 2, 1).otherwise(0).alias("more"))
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS, "span").orderBy("ord"))
    cut = placed.where("state = 1").select(*out, F.when(run <= F.col("room"), 1).otherwise(0).alias("more"))
    return whole.union(cut).select("doc_id", *LEVELS, "tokens", (F.col("epochs") + F.col("more")).cast("int").alias("copies"), *carry)
