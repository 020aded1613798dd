"""Every registered query against its SQL twin on the smallest tables; those without one run and give rows."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from inkwell import plans
from inkwell.operators import stats

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.queries())
MAY_BE_EMPTY = {"svd_ppmi", "set_except", "edit_distance_pairs", "evidence_search"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows or name in MAY_BE_EMPTY
        return
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for a, b in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-6) for x, y in zip(a, b)), (a, b)
    assert rows or name in MAY_BE_EMPTY


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n", "gram", "cnt"] and df.count() > 0


def test_registry():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(NAMES) <= set(names)


def test_nothing_else_imports_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in [*root.glob("inkwell/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "inkwell/llm" not in str(path) and path.name != "test_queries.py":
            assert not re.search(r"inkwell\.llm|from \.+llm", path.read_text()), path


def test_cooccurrence_has_rare_terms(spark):
    """Every pair of terms in five documents or more, by brute force."""
    import re
    from collections import Counter

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    tf = [Counter(w for w in re.split(r"[^\w]+", t.lower()) if len(w) >= 2) for t in texts]
    df = Counter(w for t in tf for w in t)
    want = {(a, b) for t in tf for k in [sorted(w for w in t if df[w] >= 5)] for n, a in enumerate(k) for b in k[n:]}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = stats.cooccurrence(stats.term_counts(docs, min_df=5)).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    sums = Counter()
    for t in tf[:40]:
        sums.update({("of", w): t["of"] * n for w, n in t.items() if df[w] >= 5 and w >= "of" and "of" in t})
    some = stats.cooccurrence(stats.term_counts(docs, min_df=5).where(F.col("id").isin([r.doc_id for r in docs.select("doc_id").collect()][:40]))).where("i = 'of'").collect()
    assert {(r.i, r.j): r.c for r in some} == dict(sums)


def test_coverage_takes_the_stated_queries(spark):
    items, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    got = plans.queries()["query_coverage"](spark, SF).select("item_id", "doc_id").distinct().count()
    assert got == items.where("item_id % 100 = 0").count() * docs.count()
