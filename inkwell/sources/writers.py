"""Writers: upserts, sharded stores, text and JSON outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The DNS namespace of version-5 UUIDs.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_id(s: Column) -> Column:
    """Version-5 UUID of a text in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(s, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def upserted(rows: DataFrame, order: str, content: str = "content", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, ...): one row for each content, the last ingested. ``more`` columns keep equal contents apart.

    The last row is found by a pre-aggregated maximum, so a text with very many copies is no single task's work.
    """
    key = F.concat_ws("\0", F.col(content), *[F.col(c).cast("string") for c in more]) if more else F.col(content)
    keyed = rows.withColumn("id", content_id(key))
    return keyed.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("id", "r.*")


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str, order: str) -> str:
    """Merge rows into a Parquet table by key, the larger order winning; the new version is a folder of its own.

    Returns its path. Readers of the old version aren't disturbed and a failed run leaves it as it was.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v")) if fs.exists(root) else []
    done = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/_SUCCESS"))]
    if done:
        rows = spark.read.parquet(f"{path}/v{done[-1]}").unionByName(rows, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    merged = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    out = f"{path}/v{max(versions, default=0) + 1}"
    merged.write.parquet(out)
    return out


def write_shards(rows: DataFrame, path: str, id_col: str = "seg_id", size: int = 1_000_000) -> None:
    """A store in folders of id ranges."""
    rows.withColumn("shard", F.floor(F.col(id_col) / size)).write.partitionBy("shard").parquet(path)


def write_clusters(rows: DataFrame, path: str, cluster: str = "cluster", text: str = "text") -> None:
    """A text file folder for each cluster."""
    rows.select(cluster, F.col(text).cast("string").alias("value")).write.mode("append").partitionBy(cluster).text(path)


def write_group_arrays(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """One JSON array of a paper's groups in each line."""
    rest = F.struct(*rows.columns)
    rows.groupBy(key).agg(F.to_json(F.collect_list(rest)).alias("value")).select("value").write.text(path)


def write_lines(rows: DataFrame, path: str, tokens: str | None = None, text: str | None = None) -> None:
    """Token lists or texts as lines that end in a space."""
    told = F.array_join(tokens, " ") if tokens else F.col(text)
    rows.select(F.concat(told, F.lit(" ")).alias("value")).write.text(path)


def write_paper_info(rows: DataFrame, path: str) -> None:
    """Records of eight fields, spaces within them as underscores."""
    fields = ("pmcid", "title", "journal", "journal_abbrev", "year", "month", "day", "cited_times")
    rows.select(F.concat_ws(" ", *[F.when(F.length(F.col(c).cast("string")) > 0, T.underscored(F.col(c).cast("string"))).otherwise(F.lit("N/A")) for c in fields]).alias("value")).write.mode("append").text(path)


def write_document(row: DataFrame, path: str) -> None:
    row.write.json(path)


def flat_copy(spark: SparkSession, folder: str, path: str, suffix: str = "*") -> None:
    """Matched files of a folder and all below it as one flat table of (name, content), the last path of equal names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(folder)
    named = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")
    named.groupBy("name").agg(F.max_by("content", "path").alias("content")).write.parquet(path)
