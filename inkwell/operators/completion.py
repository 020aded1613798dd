"""A stored completion trie: for every branching prefix its most frequent words, and the continuations of each lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .grams import lead_entries
from .similar import stored

#: Words kept under each node.
BEST = 100


def nodes(words: DataFrame, best: int = BEST) -> DataFrame:
    """(path, words, best): the path-compressed trie of words (gram, cnt). A prefix is a node if words go on from it in two ways
    or more, or if it is a word; each has the number of its words and the ``best`` most frequent ones, ties by name.

    Of each prefix's words tasks keep so many before anything moves, the empty prefix's too.
    """
    every = words.select("gram", "cnt", F.explode(F.sequence(F.lit(0), F.length("gram"))).alias("n")).select(
        F.expr("substring(gram, 1, n)").alias("path"), F.expr("substring(gram, n + 1, 1)").alias("on"), "gram", "cnt")
    branching = every.groupBy("path").agg(F.count_distinct("on").alias("ways"), F.max(F.col("on") == "").alias("word"), F.count("*").alias("words")).where("ways > 1 OR word OR path = ''").select("path", "words")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cnt"), "gram"))
    kept = every.withColumn("r", rank).where(F.col("r") <= best)
    listed = kept.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "gram", "cnt"))), lambda x: F.struct(x["gram"].alias("gram"), x["cnt"].alias("cnt"))).alias("best"))
    return listed.join(branching, "path")


def write_trie(counts: DataFrame, path: str, best: int = BEST) -> None:
    """Store the kept grams (n, gram, cnt) under ``path``: trie nodes by path, words by name, and continuations by lead, each
    sorted, so that a prefix or a lead is in one row group or few."""
    counts = stored(counts, "grams")
    words = counts.where("n = 1").select("gram", "cnt")
    for name, df, by in (("nodes", nodes(words, best), ["path"]), ("words", words, ["gram"]), ("leads", lead_entries(counts).select("n", "lead", "cur", "freq"), ["n", "lead", "cur"])):
        stored(df, name).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/{name}")


def node_of(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The trie's node for a prefix: the shortest path that starts with it, below which all its words are."""
    return spark.read.parquet(f"{path}/nodes").where(F.startswith("path", F.lit(prefix))).orderBy(F.length("path"), "path").limit(1)


def complete(spark: SparkSession, path: str, prefix: str, lead1: str = "", lead2: str = "", k: int | None = 20) -> DataFrame:
    """(gram, score): the best ``k`` words with a prefix after a context, as ``grams.autocomplete_rank`` ranks them; all of
    them if k is None.

    A word that follows the context is among the lead's continuations; of the others the best are those of the prefix's
    node. So the node, and the continuations that have the prefix, hold the best k. More than the nodes keep are read
    from the words by prefix.
    """
    w1, w2, w3 = K.AUTOCOMPLETE_WEIGHTS
    words = spark.read.parquet(f"{path}/words").where(F.startswith("gram", F.lit(prefix)))
    after = lambda n, lead, name: spark.read.parquet(f"{path}/leads").where((F.col("n") == n) & (F.col("lead") == lead) & F.startswith("cur", F.lit(prefix))).select(F.col("cur").alias("gram"), F.col("freq").alias(name))
    f2, f3 = after(2, lead1, "f2"), after(3, lead2, "f3")
    node = None if k is None else node_of(spark, path, prefix).select("best", "words").first()
    if k is None or node and len(node["best"]) < min(k, node["words"]):
        known = words.select("gram", F.col("cnt").alias("f1"))
    else:
        best = spark.createDataFrame([(r["gram"], r["cnt"]) for r in node["best"][:k]] if node else [], "gram string, f1 long")  # k rows
        following = words.join(f2.select("gram").union(f3.select("gram")).distinct(), "gram").select("gram", F.col("cnt").alias("f1"))
        known = best.union(following).distinct()
    scored = known.join(f2, "gram", "left").join(f3, "gram", "left").fillna(0, ["f2", "f3"])
    scored = scored.select("gram", (w1 * F.col("f1") + w2 * F.col("f2") + w3 * F.col("f3")).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "gram").limit(k)
