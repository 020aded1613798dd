"""Decomposition of sparse matrices and the completion trie against plain versions."""

import itertools
import math
import pathlib
import pickle
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import completion, grams, sparse, stats, vectors
from inkwell.plans import queries

SF = "/root/testdata/sf0.001"


def test_singular_values_are_those_of_the_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(sparse, "FAN", 2)
    rng = np.random.default_rng(1)
    a = (rng.normal(size=(70, 12)) * 0.9 ** np.arange(12)) @ rng.normal(size=(12, 50)) * (rng.random((70, 50)) < 0.4)
    i, j = np.nonzero(a)
    df = spark.createDataFrame([(f"r{p}", f"c{q}", float(a[p, q])) for p, q in zip(i, j)] + [("r0", "c0", 0.0), ("gone", "c1", None)], "i string, j string, x double").repartition(7)
    found, values = sparse.randomized_svd(df, 6, power=8)
    u, s, _ = np.linalg.svd(a)
    assert values == pytest.approx(s[:6].tolist(), rel=1e-3)
    got = {r.k: r.v for r in found.collect()}
    mine = np.array([got.get(f"r{p}", [0.0] * 6) for p in range(70)])
    assert np.allclose(mine.T @ mine, np.eye(6), atol=1e-6) and np.abs(mine[:, :3] * np.sign((mine[:, :3] * u[:, :3]).sum(0)) - u[:, :3]).max() < 1e-2
    assert all(mine[np.abs(mine[:, d]).argmax(), d] > 0 for d in range(6))


def test_small_and_empty_matrices(spark):
    one = spark.createDataFrame([("a", "b", 2.0), ("a", "b", 1.0)], "i string, j string, x double")
    found, values = sparse.randomized_svd(one, 2)
    assert values == pytest.approx([3.0, 0.0], abs=1e-9) and [(r.k, [round(x, 9) for x in r.v]) for r in found.collect()] == [("a", [1.0, 0.0])]
    found, values = sparse.randomized_svd(one.limit(0), 2)
    assert found.count() == 0 and values == []


def test_values_of_the_ppmi_matrix(spark):
    half = spark.createDataFrame([(r.i, r.j, r.pmi) for r in queries()["ppmi"](spark, SF.replace("0.001", "0.01")).collect()], "i string, j string, x double")
    names = {t: n for n, t in enumerate(sorted({r.i for r in half.collect()} | {r.j for r in half.collect()}))}
    dense = np.zeros((len(names),) * 2)
    for r in half.collect():
        dense[names[r.i], names[r.j]] = dense[names[r.j], names[r.i]] = r.x
    found, values = sparse.randomized_svd(vectors.mirrored(half), 16)
    assert values == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:16].tolist(), rel=1e-3)
    assert {r.k for r in found.collect()} == {t for t, n in names.items() if dense[n].any()}


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(150)})
    rows = [(1, w, rng.randint(1, 20)) for w in words]
    rows += [(2, g, rng.randint(1, 9)) for g in {f"{rng.choice(words)} {rng.choice(words)}" for _ in range(400)}]
    rows += [(3, g, rng.randint(1, 9)) for g in {f"a b {rng.choice(words)}" for _ in range(40)}]
    return spark.createDataFrame(rows, "n int, gram string, cnt long")


@pytest.mark.parametrize("best", [3, 100])
def test_completions_are_those_of_all_counts(spark, counts, tmp_path, best):
    completion.write_trie(counts, str(tmp_path), best)
    for prefix, lead1, lead2, k in (("", "", "", 5), ("", "b", "a b", 40), ("a", "b", "a b", 10), ("ab", "b", "", 3), ("cab", "", "a b", 20), ("zz", "b", "a b", 5), ("abc", "none", "none", 1), ("b", "b", "a b", None)):
        want = [(r.gram, round(r.score, 9)) for r in grams.autocomplete_rank(counts, prefix, lead1, lead2).collect()]
        want = sorted(want, key=lambda r: (-r[1], r[0]))[:k]
        got = [(r.gram, round(r.score, 9)) for r in completion.complete(spark, str(tmp_path), prefix, lead1, lead2, k).collect()]
        assert (got if k else sorted(got, key=lambda r: (-r[1], r[0]))) == want, (prefix, lead1, lead2, k)


def test_nodes_are_the_branching_prefixes(spark, counts):
    words = {r.gram: r.cnt for r in counts.where("n = 1").collect()}
    want = {}
    for p in {w[:n] for w in words for n in range(len(w) + 1)}:
        below = [w for w in words if w.startswith(p)]
        if p in words or not p or len({w[len(p):len(p) + 1] for w in below}) > 1:
            want[p] = (len(below), sorted(((w, words[w]) for w in below), key=lambda x: (-x[1], x[0]))[:4])
    got = {r.path: (r.words, [tuple(x) for x in r.best]) for r in completion.nodes(counts.where("n = 1").select("gram", "cnt"), 4).collect()}
    assert got == want


def test_a_prefix_is_read_by_its_range(spark, counts, tmp_path):
    completion.write_trie(counts, str(tmp_path))
    plan = completion.node_of(spark, str(tmp_path), "ab")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,ab)" in plan


def test_products_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    for name, value in {"ENTRIES": 500, "PAIRS": 50, "CHUNK": 7, "BATCH": 40}.items():
        monkeypatch.setattr(stats, name, value)
    rng = random.Random(5)
    kept = {(d, f"t{t}"): rng.randint(1, 5) for d in range(200) for t in rng.sample(range(60), rng.randint(1, 40))}
    tf = spark.createDataFrame([(d, t, n) for (d, t), n in kept.items()], "id long, term string, tf long").repartition(5)
    want, texts = {}, {}
    for (d, t), n in kept.items():
        texts.setdefault(d, []).append((t, n))
    for own in texts.values():
        for (a, m), (b, n) in itertools.product(own, own):
            if a <= b:
                want[a, b] = want.get((a, b), 0) + m * n
    rows = stats.cooccurrence(tf).collect()
    assert len(rows) == len(want) and {(r.i, r.j): r.c for r in rows} == want
    rows = stats.pmi_of_counts(tf, 200).collect()
    log = lambda a, b: math.log2(want[a, b] / 200)
    assert {(r.i, r.j): round(r.pmi, 6) for r in rows} == {(a, b): round(log(a, b) - log(a, a) - log(b, b), 6) for a, b in want}
    assert stats.cooccurrence(tf.limit(0)).count() == 0


def test_pairs_are_neither_joined_nor_shuffled(spark):
    plan = queries()["ppmi"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Repartition") and "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0]


def test_counts_of_blocks_are_not_shuffled(spark):
    """Only numbers of pairs of blocks move once the texts are counted."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f: f.stat().st_size for d in manager.localDirsString() for f in pathlib.Path(d).rglob("shuffle_*.data")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = stats.cooccurrence(stats.counted(docs, min_df=5) if hasattr(stats, "counted") else stats.term_counts(docs, min_df=5))
    before = held()
    assert pairs.count() > 1000
    assert sum(n for f, n in held().items() if f not in before) < 20_000


def test_texts_without_an_id_and_with_one_twice(spark):
    """As the SQL has it: rows of one id are one text, and one without an id meets nothing but counts as a text of a term."""
    import duckdb

    from inkwell.plans import relations

    rng = random.Random(8)
    for ids in ([*range(40)], [*range(40), None], [*range(40), 3, 3, 7, None, None]):
        rows = [(n, " ".join(rng.choice(["ab", "cd", "\u00c9t", "x", "gh_1", "ij"]) + rng.choice([" ", ". "]) for _ in range(rng.randint(0, 9)))) for n in ids] + [(100, None), (101, "")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = con.execute(relations.QUERIES["cooccurrence"][1].replace(f">= {relations.MIN_DF}", ">= 15")).fetchall()
        got = stats.cooccurrence(stats.counted(docs, min_df=15), docs.count()).select("i", "j", F.round("c", 6).alias("c")).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3


def test_vectors_of_a_matrix_in_tiles(spark, monkeypatch):
    """Those of the same matrix in long form, read in place: no entry is joined or shuffled."""
    for name, value in {"ENTRIES": 500, "PAIRS": 50, "BATCH": 40}.items():
        monkeypatch.setattr(stats, name, value)
    rng = random.Random(6)
    docs = spark.createDataFrame([(d, " ".join(rng.sample([f"t{t}" for t in range(30 * (d % 2), 30 + 30 * (d % 2))], rng.randint(2, 20)))) for d in range(200)] + [(999, "alone")], "doc_id long, text string")
    blocks = stats.counted(docs)
    tiles = stats.positive_information(blocks, 201)
    assert len(blocks.parts) > 1
    half = stats.pmi_of_counts(stats.term_counts(docs), 201, positive=True).select("i", "j", F.col("pmi").alias("x")).where("x > 1e-12")
    entries = vectors.mirrored(half)
    want, values = sparse.randomized_svd(entries, 4)
    met, got, same = sparse.symmetric_svd(tiles, blocks.terms, blocks.edges, 4)
    want = {r.k: r.v for r in want.collect()}
    assert same == pytest.approx(values, rel=1e-9) and [blocks.terms[int(i)].as_py() for i in met] == sorted(want)
    assert np.abs(got - np.array([want[t] for t in sorted(want)])).max() < 1e-6
    met, got, same = sparse.symmetric_svd(tiles.limit(0), blocks.terms, blocks.edges, 4)
    assert len(met) == len(got) == 0 and same == []


def test_svd_ppmi_has_no_joins(spark):
    plan = queries()["svd_ppmi"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Scan parquet" not in plan and "Relation" not in plan.replace("LocalRelation", "")


def test_a_pair_of_blocks_holds_few_bytes_for_a_count(spark):
    import tracemalloc

    rng = np.random.default_rng(4)

    def block(many=4_000, each=50, width=3_000):
        place = np.sort(rng.integers(0, width, (many, each)), 1).ravel()
        return pickle.dumps([(0, stats._told([np.arange(many), np.full(many, each), place, np.full(many * each, 2)]))])

    one, other = (stats._side(SimpleNamespace(value=block())) for _ in range(2))
    assert [x.dtype for x in one] == [np.int64, np.int32, np.int32, np.int32]
    tracemalloc.start()
    sums = sum(total.sum() for _, total in stats._products(one, other, 3_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums == 4 * 4_000 * 50 * 50
    assert peak < 40 * 200_000 + 60 * stats.PAIRS  # beside the counts themselves
