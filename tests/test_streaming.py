"""Running counts in levels against plain sums."""

import os
from collections import Counter

import pytest

from inkwell.operators import grams
from inkwell.streaming import incremental


def test_each_batch_is_covered_once(monkeypatch):
    monkeypatch.setattr(incremental, "MERGED", 3)
    for n in range(60):
        seen = [b for level, last in incremental.cover(n) for b in range(last - 3 ** level + 1, last + 1)]
        assert seen == list(range(n)) and len(incremental.cover(n)) <= 2 * 4


@pytest.mark.parametrize("again", [False, True])
def test_levels_hold_the_sums_also_after_batches_that_run_again(spark, tmp_path, monkeypatch, again):
    monkeypatch.setattr(incremental, "MERGED", 2)
    want, out = Counter(), str(tmp_path)
    for number in range(5):
        rows = [(2, f"g{number % 3}", number + 1), (2, "all", 1)]
        df = spark.createDataFrame(rows, "n int, gram string, cnt long").coalesce(1)
        for _ in range(2 if again else 1):
            incremental.add_counts(df, number, out)
        want.update({g: c for _, g, c in rows})
    assert {r.gram: r.cnt for r in incremental.gram_totals(spark, out).collect()} == dict(want)
    left = sorted(f"{level}/{batch}" for level in os.listdir(out) for batch in os.listdir(f"{out}/{level}"))
    assert left == ["level=0/batch=4", "level=2/batch=3"]


def test_a_stream_goes_on_with_new_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGED", 2)
    schema = "doc_id long, text string"
    for run in range(2):
        for i in range(2):
            spark.createDataFrame([(i, f"alpha beta run{'ab'[run]} alpha beta")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        texts = incremental.file_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1)
        got = {r.gram: r.cnt for r in incremental.stream_gram_counts(texts, f"{tmp_path}/out", f"{tmp_path}/state").collect()}
        assert got["alpha beta"] == 4 * (run + 1)
    assert incremental.gram_totals(spark, f"{tmp_path}/nothing").count() == 0


@pytest.mark.parametrize("folder", [False, True])
def test_the_stream_queries_read_a_table_that_is_a_folder_of_files(spark, tmp_path, folder):
    from inkwell.plans import graphs

    source = "/root/testdata/sf0.001/documents.parquet"
    if folder:
        spark.read.parquet(source).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        os.symlink(source, f"{tmp_path}/documents.parquet")
    got = {name: graphs.QUERIES[name][0](spark, str(tmp_path)) for name in ("stream_resume", "stream_gram_counts")}
    rows = spark.read.parquet(source)
    assert sorted(map(tuple, got["stream_resume"].collect())) == sorted((r.doc_id, len(r.text)) for r in rows.collect())
    want = grams.count_grams(rows, orders=(2,))
    assert not want.count() == 0 and got["stream_gram_counts"].exceptAll(want).isEmpty() and want.exceptAll(got["stream_gram_counts"]).isEmpty()
