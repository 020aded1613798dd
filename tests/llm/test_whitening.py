"""Whitening against a dense eigendecomposition of all rows."""

import math

import numpy as np
import pytest

from inkwell.llm import queries, whitening


def integers(vectors):
    return np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)


def held_to_dense(rows, vectors):
    """rows: results; vectors: (vec_id, entries) of the rows that remain, ids distinct."""
    x, ids = integers([v for _, v in vectors]), [i for i, _ in vectors]
    n, s = len(x), x.sum(0)
    t = n * x - s
    c = t.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    k = min(8, x.shape[1])
    assert len(by) == len(rows) == n * k
    for j in range(k):
        mine = [by[i, j + 1] for i in ids]
        assert {r.n for r in mine} == {n} and [int(r.deviation) for r in mine] == [int(v) for v in (t * t).sum(1)]
        want = c @ u[:, j] / np.sqrt(e[j])
        got = np.array([r.whitened for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert all(r.explained == pytest.approx(e[j] / e.sum(), rel=1e-9) for r in mine)
    white = np.array([[by[i, j + 1].whitened for j in range(k)] for i in ids])
    white = white - white.mean(0)
    error = np.abs(white.T @ white / n - np.eye(k)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and abs(rows[0].identity_error - error) < 1e-9 and error < 1e-4


def test_query_is_dense_on_the_whole_table(spark, sf):
    rows = queries.queries()["op11_whitening"](spark, sf).collect()
    held_to_dense(rows, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    assert all(int(r.deviation_exact) == r.deviation for r in rows)


def test_merges_of_many_levels_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=5) * [3, 1, 1, 0.1, 0.01]).tolist()) for i in range(90)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(9)
    held_to_dense(whitening.whiten_embeddings(df).collect(), vectors)


def test_merged_is_the_decomposition_of_both():
    rng = np.random.default_rng(2)
    x = rng.integers(99_000, 101_000, (50, 6))
    both, parts = whitening.Spread.of(x), whitening.Spread.of(x[:3]).merged(whitening.Spread.of(x[3:20])).merged(whitening.Spread.of(x[20:]))
    assert parts.n == both.n and parts.sums == both.sums and np.allclose(parts.s, both.s, rtol=1e-12)
    assert np.allclose(abs((parts.v * both.v).sum(1)), 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0], 7), (1, [0.5, 1.0, 2.0], 7), (None, [0.1, -1.0, 0.0], None), (2, None, 1), (3, [1.0, None, 2.0], 1), (4, [1.0, nan, 2.0], 1), (5, [inf, 1.0, 2.0], 1),
            (6, [], 1), (7, [1.0, 2.0], 1), (8, [9.0, 8.0, -3.0], 1), (9, [0.0, 2.0, 1.5], 1)]
    df = spark.createDataFrame([(i, v, c, 0, 0.5) for i, v, c in rows], "vec_id long, embedding array<float>, n int, component int, whitened double")
    got = whitening.whiten_embeddings(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i in (1, 1, None, 8, 9) for _ in range(3))
    assert {r.n for r in got} == {5}
    assert whitening.whiten_embeddings(df.limit(0)).collect() == [] and whitening.whiten_embeddings(df.where("vec_id > 1 AND vec_id < 7")).collect() == []


def test_directions_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten_embeddings(df).collect()
    assert len(got) == 12 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 12) for r in got} == {0.0, 1.0} and got[0].identity_error < 1e-9
    same = whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0])] * 2, "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same} == {(None, 0.0, None, 0)}


def test_deviations_beyond_64_bits(spark):
    vectors = [(i, [float(i * 10**6), -float(i), 5.0 * 10**8]) for i in range(300)]
    got = whitening.whiten_embeddings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = integers([v for _, v in vectors])
    t = len(x) * x - x.sum(0)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: int(v) for i, v in enumerate((t * t).sum(1))} and max((t * t).sum(1)) > 2**63
