from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import decontam, mixing, pipeline, quality, sharding, simhash
from inkwell.llm.common import with_row_key, without_rows
from inkwell.llm.queries import SHARDS, WEIGHTS

from .conftest import text_of
from .test_corpus_stages import plain_hits
from .test_simhash import shingle_set


def test_stages_keep_what_they_should(spark, sf):
    """Each stage on its own input: its decisions take effect and nothing else changes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.keep}
        elif name == "near_dedup":
            want = {r.group_id for r in simhash.near_copies(docs).collect()}
        elif name == "decontamination":
            want = {i for i in before if not plain_hits(texts[i], items)}
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs, WEIGHTS).collect()}
            want = {i for i, n in copies.items() if n}
        out = corpus_pipeline.materialize(stage(spark, docs, sf))
        rows = out.collect()
        assert out.columns == columns + (["shard"] if name == "sharding" else [])
        assert {r.doc_id for r in rows} == (want if name != "sharding" else before)
        assert all(r.text == texts[r.doc_id] for r in rows)
        if name == "near_dedup":
            kept = [shingle_set(texts[r.doc_id]) for r in rows]
            assert len(rows) == len(want) and len({frozenset(s) for s in kept}) == len(kept)
        if name == "mixing":
            assert len(rows) == sum(copies.values())
        docs = out
    assert len(rows) == corpus_pipeline.run(spark, sf).count()


def test_stages_on_odd_rows(spark, odd, none, sf):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = corpus_pipeline.materialize(stage(spark, docs, sf))
            assert docs.columns[:len(columns)] == columns or "shard" in columns
    assert decontam.RADIUS and sharding.fill_table(SHARDS)


def test_rows_without_id_or_with_the_same_one_are_judged_one_by_one(spark, sf):
    """Good and bad rows of one id and of none: each stage drops the bad ones only."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    keep = quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).join(docs.select("doc_id", "text", "lang", "source"), "doc_id")
    good, bad = (keep.where(c).orderBy("quality" if c != "keep" else F.desc("quality"), "doc_id").first() for c in ("keep", "NOT keep"))
    stages = dict(pipeline.STAGES)

    def kept(name, texts):
        rows = [(i, t, good.lang, good.source, len(t)) for t in texts for i in (None, 999_999)]
        more = spark.createDataFrame(rows, docs.schema)
        out = stages[name](spark, docs.where("doc_id < 100").union(more), sf)
        assert out.columns == docs.columns
        return sorted((r.doc_id is None, texts.index(r.text)) for r in out.where("doc_id IS NULL OR doc_id = 999999").collect())

    own = [" ".join(f"{w}{k}" for w in "one two three four five six seven eight".split()) for k in "ab"]
    assert kept("quality", [good.text, bad.text, good.text]) == [(n, 0) for n in (False, False, True, True)]
    assert kept("near_dedup", own) == [(False, 0), (False, 1)]
    assert kept("decontamination", [own[0], f"{own[1]} {item} end", own[0]]) == [(n, 0) for n in (False, False, True, True)]


def test_mixing_uses_each_row_by_its_own_leaf(spark, sf):
    """Rows of one id in leaves with and without budget, and repeated rows."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(i, text_of(i or 7, 30), lang, "s", 1) for i in (1, 1, 2, None, None, 3) for lang in ("en", "de", None)]
    docs = spark.createDataFrame(rows, schema)
    want = mixing.mix(docs, WEIGHTS).groupBy("doc_id", "lang").sum("copies").collect()
    got = pipeline.mix_sources(spark, docs, sf).groupBy("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((str(r[0]), r[1], r[2]) for r in want if r[2])


def test_row_keys(spark, sf):
    """Rows of a scan, of a filtered scan and of any other table are told apart; names don't clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, docs.where("doc_id % 2 = 0").select("text", "doc_id"), docs.union(docs), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("row_file")), docs.limit(0)):
        rows, key = with_row_key(df)
        assert rows.columns == [*df.columns, *key] and rows.select(*key).distinct().count() == df.count() == rows.count()
        assert without_rows(rows, rows.select(*key).limit(1), key).count() == max(0, df.count() - 1)
