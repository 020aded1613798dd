"""Joins, set algebra and lookups of the batch jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(records: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Records that have a count."""
    return records.join(counts, key)


def present(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(listed.select(key), key, "left_semi")


def missing(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed: what remains to be done."""
    return rows.join(listed.select(key), key, "left_anti")


def by_journal(index: DataFrame, journals: DataFrame, key: str = "journal") -> DataFrame:
    """Index rows of the listed journals, names compared with spaces as underscores."""
    names = journals.select(F.translate(key, " ", "_").alias("__j"))
    return index.join(names, F.translate(index[key], " ", "_") == names["__j"], "left_semi")


def look_up(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Rows with a value from a table, the default where the key isn't there."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def collect_groups(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): a key's values in order. For keys whose values fit a row."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def collect_pages(rows: DataFrame, key: str, value: str, width: int = 1_000) -> DataFrame:
    """(key, page, values): a key's whole numbers in order, in pages by ranges of ``width``, for keys of any size."""
    paged = rows.groupBy(key, F.floor(F.col(value) / width).alias("page"))
    return paged.agg(F.sort_array(F.collect_list(value)).alias("values"))


def union_keys(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables).distinct()


def multiset_common(a: DataFrame, b: DataFrame, removed: bool = False) -> DataFrame:
    """Rows in both, as often as in both; ``removed`` gives what is left of ``a``."""
    return a.exceptAll(b) if removed else a.intersectAll(b)


def subset(a: DataFrame, b: DataFrame) -> bool:
    """Whether every row of ``a`` is in ``b``."""
    return a.exceptAll(b.distinct()).isEmpty() if a.isEmpty() else a.join(b.distinct(), list(a.columns), "left_anti").isEmpty()


def sum_by_key(keys: DataFrame, boxes: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Sum of each asked key over all boxes, 0 where there is none."""
    sums = boxes.groupBy(key).agg(F.sum(value).alias("total"))
    return keys.join(sums, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"))


def latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row for each key, the one with the largest order; pre-aggregated, so a hot key is no single task's work."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def numbered(rows: DataFrame, keys: list[str], *order: str, into: str = "idx") -> DataFrame:
    """Places from 1 within keys; numbering again after a deletion closes the gap."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def islands(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, first, last): runs of consecutive places."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return rows.withColumn("__g", run).groupBy(*keys, "__g").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("__g")


def flush_bucket(id_: Column, start: int = 0, size: int = 100_000) -> Column:
    """Bucket of an id when every ``size`` ids are written out."""
    return F.floor((id_ - start) / size).cast("long")


def index_map(rows: DataFrame, values: str) -> DataFrame:
    """(value, idx): place of each value of an array from 0, the last of equals."""
    return rows.select(F.posexplode(values).alias("idx", "value")).groupBy("value").agg(F.max("idx").alias("idx"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the key's latest right value at or before its time, by one union and window."""
    rows = right.select(key, time, F.col(value).alias("__v"), F.lit(0).alias("__side")).unionByName(left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, value)
