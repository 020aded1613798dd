"""Session factory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for any size of data: partitions follow the data at run time, skewed joins are split, times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all machines share. Without that setting only a local master may go on."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


#: Spark's setting to delete an action's shuffle files at its end, not when the driver's memory is next collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet and delete the shuffle files that only this took. The setting is put back."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN_UP)
        else:
            conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(app: str = "inkwell", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
