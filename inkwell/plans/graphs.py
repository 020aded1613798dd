"""Queries on graphs, hierarchies and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, graph
from ..operators.similar import stored
from ..session import scratch
from ..streaming import incremental
from . import common as C
from .common import register, table

QUERIES: dict = {}


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the parts that they bought."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


_EDGES = "edges AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), links AS (SELECT DISTINCT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@register(QUERIES, f"WITH {_EDGES} SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_edges(spark, d))


@register(QUERIES, f"WITH {_EDGES} SELECT DISTINCT dst AS id FROM links WHERE src = 'c1'")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), spark.createDataFrame([("c1",)], "id string"))


@register(QUERIES, f"WITH {_EDGES}, a AS (SELECT DISTINCT dst AS id FROM links WHERE src = 'c1') SELECT DISTINCT dst AS id FROM links JOIN a ON src = id")
def graph_expand_k(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(stored(_edges(spark, d), "edges"), spark.createDataFrame([("c1",)], "id string"), 2)


@register(QUERIES, f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'c1' AS id UNION SELECT dst FROM reach JOIN links ON src = id) SELECT id FROM reach")
def graph_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand_to(stored(_edges(spark, d), "edges"), spark.createDataFrame([("c1",)], "id string"))


def layerwise_division(spark: SparkSession, d: str) -> DataFrame:
    return cluster.layerwise_division(table(spark, d, "embeddings"), 3, 2)


QUERIES["layerwise_division"] = (layerwise_division, None)


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files: those of the table's folder, or the one file that the table is, which only a
    pattern may name."""
    return incremental.file_stream(spark, f"{d}/documents.parque[t]", table(spark, d, "documents").schema)


@register(QUERIES, f"WITH {C.gram_counts((2,))} SELECT n, gram, cnt FROM counts")
def stream_gram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bigram counts of the documents read as a stream of files."""
    at = scratch(spark, "streams")
    texts = _arriving(spark, d)
    return incremental.stream_gram_counts(texts, f"{at}/out", f"{at}/state")


@register(QUERIES, "SELECT doc_id, CAST(length(text) AS INTEGER) AS size FROM documents")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents processed once although the job runs twice."""
    at = scratch(spark, "streams")
    texts = _arriving(spark, d)
    for _ in range(2):
        incremental.resume(texts, lambda t: t.select("doc_id", F.length("text").alias("size")), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")
