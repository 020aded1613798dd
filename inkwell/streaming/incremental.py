"""Incremental runs on Structured Streaming: files in, exactly-once state by checkpoint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, grams

#: Folders of one level of running counts that become one of the next.
MERGED = 8


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream, so many in each micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def cover(batches: int, start: int = 0) -> list[tuple[int, int]]:
    """(level, last batch) of the folders that hold so many batches from ``start`` on, each batch once."""
    out = []
    while start < batches:
        level = 0
        while start % MERGED ** (level + 1) == 0 and start + MERGED ** (level + 1) <= batches:
            level += 1
        out.append((level, start + MERGED ** level - 1))
        start += MERGED ** level
    return out


def add_counts(counts: DataFrame, number: int, out: str) -> None:
    """Put a batch's counts (n, gram, cnt) into the levels under ``out``.

    A batch is a folder of level 0; MERGED folders of a level become one of the next. So a batch's work is, on average,
    its own counts once for each level, however many came before, and a reader sums a few folders of each level. What a
    batch merged is deleted when the next one begins, since by then the batch is known to be done: one that runs again
    finds all that it read, and writes the same folders over.
    """
    spark = counts.sparkSession
    folder = lambda level, last: f"{out}/level={level}/batch={last}"

    def parts(last: int):
        level = 1
        while (last + 1) % MERGED ** level == 0 and last >= 0:
            yield level, [folder(level - 1, last - i * MERGED ** (level - 1)) for i in range(MERGED)]
            level += 1

    for _, old in parts(number - 1):
        for path in old:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    counts.write.mode("overwrite").parquet(folder(0, number))
    for level, old in parts(number):
        grams.merge_counts(spark.read.parquet(*old)).write.mode("overwrite").parquet(folder(level, number))


def gram_totals(spark: SparkSession, out: str) -> DataFrame:
    """(n, gram, cnt) of all batches under ``out``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/level=*/batch=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    batches = max((int(f.getPath().getName().removeprefix("batch=")) + 1 for f in found), default=0)
    if not batches:
        return spark.createDataFrame([], "n int, gram string, cnt long")
    return grams.merge_counts(spark.read.parquet(*[f"{out}/level={level}/batch={last}" for level, last in cover(batches)]))


def stream_gram_counts(texts: DataFrame, out: str, checkpoint: str, text_col: str = "text", orders=(2,)):
    """Running gram counts: each batch's partial counts are added to the levels of ``add_counts``; finished when all files
    are read. A later run with the same folders goes on with new files, and nothing counts twice."""
    write = lambda batch, number: add_counts(grams.count_grams(batch, text_col, orders), number, out)
    q = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return gram_totals(texts.sparkSession, out)


def resume(texts: DataFrame, process, out: str, checkpoint: str) -> None:
    """Process files that haven't been processed: a second run reads new files only."""
    q = process(texts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fit_centers(vectors: DataFrame, start: list[list[float]], checkpoint: str, state: str, col: str = "embedding", decay: float = 1.0, reassign: float = 0.05) -> list[list[float]]:
    """Mini-batch centres over a stream of vectors, resumed where an earlier run ended.

    Every batch reads the newest centres of the batches before it in the folder ``state`` and writes its own under its
    number, so a second run goes on and a batch that runs again counts once.
    """
    spark = vectors.sparkSession

    def newest(before: int) -> tuple[list[list[float]], list[float]]:
        try:
            rows = spark.read.schema("batch long, i int, center array<double>, weight double").parquet(state).where(F.col("batch") < before)
            last = rows.agg(F.max("batch")).first()[0]
        except AnalysisException:  # no folder yet
            last = None
        if last is None:
            return [[float(x) for x in c] for c in start], [0.0] * len(start)
        kept = rows.where(F.col("batch") == last).orderBy("i").collect()
        return [list(r["center"]) for r in kept], [r["weight"] for r in kept]

    def step(batch: DataFrame, number: int) -> None:
        centers, weights = cluster.update_centers(*newest(number), batch, col, decay, reassign, number)
        rows = [(i, c, float(w)) for i, (c, w) in enumerate(zip(centers, weights))]
        spark.createDataFrame(rows, "i int, center array<double>, weight double").coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={number}")

    q = vectors.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return newest(1 << 62)[0]


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind, with a watermark for late rows. Times without a zone are the session's."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), kind, "n", "total")
