"""Similarity joins, spanning trees and the stored cell index against plain versions."""

import numpy as np
import pytest

from inkwell.operators import cells, cluster, similar
from inkwell.plans import queries

SF = "/root/testdata/sf0.001"


def rows_of(rng, n=60):
    """Vectors in two groups and one without a name, with copies, a zero vector, and null ones."""
    made = [(i, rng.normal(size=6).round(1).tolist(), ("a", "b", None)[i % 3]) for i in range(n)]
    made += [(n + i, made[i % 4][1], made[i % 4][2]) for i in range(20)]
    return made + [(500, [0.0] * 6, "a"), (501, None, "a"), (None, made[0][1], "a"), (502, [2 * x for x in made[1][1]], made[1][2])]


def plain(rows):
    """Representatives (smallest id of equal vectors) by group, with unit vectors."""
    groups = {}
    for i, v, g in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        groups.setdefault(g, {}).setdefault(tuple(v), []).append(i)
    return groups


@pytest.mark.parametrize("block", [3, 1000])
def test_links_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = rows_of(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, label string, sim double, block string")
    found, linked = similar.similarity_join(df, 0.4)
    groups = plain(rows)
    want, best = {}, {}
    for g, by in groups.items():
        reps = [(ids[0], np.array(v), len(ids)) for v, ids in by.items()]
        for a, (i, x, n) in enumerate(reps):
            for j, y, _ in reps[a + 1:]:
                if x.any() and y.any():
                    s = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
                    if s >= 0.4:
                        want[g, min(i, j), max(i, j)] = s
                    best[g, i], best[g, j] = max(best.get((g, i), -1), s), max(best.get((g, j), -1), s)
            if n > 1:
                best[g, i] = 1.0
    got = {(r.grp, r.i, r.j): r.sim for r in linked.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20
    members = {(r.grp, r.rep, r.id) for r in similar.membership(df, found).collect()}
    assert members == {(g, ids[0], i) for g, by in groups.items() for ids in by.values() for i in ids}

    def factor(s):
        return next((t for above, t in ((0.95, s), (0.6, 0.95), (0.5, 0.9), (0.4, 0.8), (0.35, 0.7)) if s > above), 0.7 if s > 0.35 else None) / s

    for r in similar.adjusted_links(found, linked).collect():
        s = want[r.grp, r.i, r.j]
        assert r.sim == pytest.approx((min(1, s * factor(best[r.grp, r.i])) + min(1, s * factor(best[r.grp, r.j]))) / 2, abs=1e-5)


def plain_single_linkage(by, k):
    reps = [(ids[0], np.array(v)) for v, ids in by.items() if np.any(v)]
    edges = sorted((round(1 - float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), min(i, j), max(i, j)) for a, (i, x) in enumerate(reps) for j, y in reps[a + 1:])
    own, left = {i: i for i, _ in reps}, len(reps)
    for _, i, j in edges:
        if left <= k:
            break
        a, b = own[i], own[j]
        if a != b:
            own = {n: min(a, b) if c in (a, b) else c for n, c in own.items()}
            left -= 1
    number = {c: n for n, c in enumerate(sorted(set(own.values())))}
    return {i: number[own[ids[0]]] for ids in by.values() if ids[0] in own for i in ids}


@pytest.mark.parametrize("block", [4, 1000])
def test_single_linkage_by_plain_merging(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = rows_of(np.random.default_rng(2), 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {(r.grp, r.id): r.cluster for r in cluster.single_linkage(df, 3).collect()}
    assert got == {(g, i): c for g, by in plain(rows).items() for i, c in plain_single_linkage(by, 3).items()}


def test_similarity_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    found, linked = similar.similarity_join(none, 0.5)
    assert found.count() == linked.count() == cluster.single_linkage(none, 2).count() == 0


def test_blocks_that_cannot_hold_a_link_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 5)
    rng = np.random.default_rng(3)
    centres = np.eye(8)
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(160)]
    packed = similar.stored(similar.blocks(similar.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))), "blocks")
    n = packed.count()
    assert similar.block_pairs(packed, 0.9).count() < n * (n + 1) / 2 / 4
    assert similar.links(packed, 0.9).count() == 8 * 20 * 19 // 2


def test_cell_search_has_its_recall_and_reads_its_cells(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = {}
    for r in queries()["knn_batch_merge"](spark, "/root/testdata/sf0.1").collect():
        exact.setdefault(r.query_id, {})[r.id] = r.distance
    got = {}
    for r in queries()["ivf_knn"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.id] = r.distance
    assert got.keys() == exact.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[q].keys() & exact[q].keys()) / 10 for q in exact]) >= 0.9
    assert all(abs(got[q][i] - exact[q][i]) < 1e-5 for q in exact for i in got[q].keys() & exact[q].keys())
    cells.write_cells(rows, str(tmp_path), cells=16)
    read = cells.probed(spark, str(tmp_path), [3, 5])
    assert {f.rsplit("/", 2)[1] for f in read.inputFiles()} >= {"cell=3", "cell=5"} and "PartitionFilters: [" in read._jdf.queryExecution().toString()
    assert 0 < read.count() < rows.count() and spark.read.parquet(f"{tmp_path}/rows").count() == rows.count()
    metrics = read._jdf.queryExecution().executedPlan()
    while metrics.children().size():
        metrics = metrics.children().head()
    read.collect()
    assert metrics.metrics().apply("numPartitions").value() == 2


def test_all_cells_give_the_exact_answer(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    cells.write_cells(df, str(tmp_path), cells=8, pieces=3)
    asked = spark.createDataFrame([(7, x[7].tolist()), (8, x[8].tolist()), (9, None)], "query_id long, query_vec array<double>")
    got = cells.search_cells(spark, str(tmp_path), asked, 5, probes=8, refine=60).orderBy("query_id", "rank").collect()
    d = cells.squared(x.astype(np.float32).astype(float)[:], x)
    assert [(r.query_id, r.id) for r in got] == [(q, int(i)) for q in (7, 8) for i in np.argsort(d[:, q], kind="stable")[:5]]
    assert cells.search_cells(spark, str(tmp_path), asked.limit(0), 5).count() == 0


def test_blocks_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "TILE", 3)
    x = np.random.default_rng(3).normal(size=(120, 4))
    df = spark.createDataFrame([(n, None if n % 2 else 1, v.tolist()) for n, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    linked = similar.similarity_join(df, 0.5)[1]
    assert "FlatMapGroupsInArrow" in linked._jdf.queryExecution().optimizedPlan().toString()  # not one row for each pair of blocks
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and sim[i, j] >= 0.5}
    rows = linked.collect()
    assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == want
