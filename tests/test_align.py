"""Aligned-word similarity against a plain version, pair by pair."""

import numpy as np
import pytest

from inkwell.operators import align

RNG = np.random.default_rng(3)
VECTORS = {w: RNG.normal(size=5) for w in "abcdefghij"} | {"z": np.zeros(5)}


def plain(a, b, side):
    """One pair, word by word."""
    if not a or not b:
        return 1.0

    def like(x, y):
        u, v = VECTORS.get(x), VECTORS.get(y)
        return 0.0 if u is None or v is None or not u.any() or not v.any() else float(u @ v / np.sqrt((u @ u) * (v @ v)))

    measure, other = (a, b) if (len(a) < len(b) if side == "short" else len(a) > len(b)) else (b, a)
    common = sum(min(a.count(w), b.count(w)) for w in set(a))
    mean = sum(max(like(x, y) for y in other) for x in measure) / len(measure)
    return (mean * (len(measure) - common) + common) / len(measure)


def some(n, longest):
    letters = list("abcdefghij") + ["z", "unknown"]
    return [[str(w) for w in RNG.choice(letters, RNG.integers(0, longest))] for _ in range(n)]


@pytest.mark.parametrize("side", ["short", "long"])
@pytest.mark.parametrize("cells", [1, 4_000_000])
def test_every_pair(side, cells, monkeypatch):
    """Whole matrices, also with sentences cut into pieces."""
    monkeypatch.setattr(align, "CELLS", cells)
    asked, rows = [[], *some(20, 9)], [[], *some(60, 12), some(1, 400)[0] + ["a"] * 200]
    got = np.full((len(asked), len(rows)), np.nan)
    for first, part in align.similarities(asked, rows, VECTORS, side):
        got[:, first:first + part.shape[1]] = part
    assert np.allclose(got, [[plain(a, b, side) for b in rows] for a in asked])


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_best_of_whole_database(spark, chunk, monkeypatch):
    """Chunks and blocks of any size give what all pairs give; copies are one sentence; nulls and other columns don't matter."""
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "ASKED", 3)
    asked, rows = some(8, 6), some(50, 8)
    rows += rows[:10]
    frame = lambda xs: spark.createDataFrame([(t, "x") for t in xs] + [(None, "x")], "tokens array<string>, word string")
    words = spark.createDataFrame([(w, [float(x) for x in v], 1) for w, v in VECTORS.items()] + [("unknown", None, 1)], "word string, vec array<double>, tokens int")
    got = {(r.query, r.rank): (r.sentence, r.sim, r.copies) for r in align.compare(frame(rows), frame(asked), words, 4).collect()}
    want = {}
    for a in asked:
        best = sorted({(-round(plain(a, b, "short"), 6), " ".join(b)) for b in rows})[:4]
        want |= {(" ".join(a), i + 1): (s, -d, rows.count(s.split())) for i, (d, s) in enumerate(best)}
    assert got.keys() == want.keys()
    for key, (s, sim, copies) in want.items():
        assert got[key][1] == pytest.approx(sim, abs=2e-6) and (got[key][0], got[key][2]) == (s, copies), (key, got[key], s, sim)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "tokens array<string>")
    words = spark.createDataFrame([], "word string, vec array<double>")
    some_rows = spark.createDataFrame([(["a"],)], "tokens array<string>")
    assert align.compare(none, some_rows, words, 3).count() == 0 == align.compare(some_rows, none, words, 3).count()
    assert align.compare(some_rows, some_rows, words, 3).first()["sim"] == 1.0
