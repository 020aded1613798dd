"""Written tables leave no shuffle files behind; searches read their table a fixed number of times."""

import random
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.operators import similar, vectors
from inkwell.session import CLEAN_UP


def test_shuffle_files_go_with_the_write(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    for write in (common.materialize, lambda df: similar.stored(df, "counts")):
        before, setting = held(), spark.conf.get(CLEAN_UP, None)
        written = write(counts)
        assert not held() - before and spark.conf.get(CLEAN_UP, None) == setting
        assert [r.n for r in written.collect()] == [100] * 100
    assert counts.count() == 100  # a table that was written can be used again


def test_nearest_reads_the_table_no_more_for_more_queries(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, [float(rng.randint(-2, 2)) for _ in range(5)]) for n in range(300)]  # many ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [1e300] * 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    asked = df.where("vec_id % 20 = 0 AND vec_id < 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    found = vectors.nearest(df, asked, 4, block=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2
    q = asked.withColumnRenamed("query_vec", "q")
    far = df.crossJoin(q).select("query_id", F.col("vec_id").alias("id"), vectors.squared_l2(F.col("embedding"), F.col("q")).alias("distance"))
    want = far.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where("rank <= 4")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 60
