"""Periodic runs against all lags by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from inkwell.llm import periodic, queries


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(12, 2 * q) and not any(w[start:start + length - p] == w[start + p:start + length] for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng):
    n, k = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 20])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            a = rng.randrange(n)
            p, e = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
            for i in range(a, e):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_and_counts_by_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        w = repeating(rng)
        assert periodic.find_runs(np.array(w, np.int32)) == brute_runs(w)
        most = len(w) // 2
        if most:
            got = periodic.lag_matches(np.array(w), most)
            assert [int(x) for x in got[1:]] == [sum(a == b for a, b in zip(w, w[q:])) for q in range(1, most + 1)]


def test_heavy_words_are_counted_by_fft():
    rng = np.random.default_rng(2)
    w = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 900, 3000))  # word 0 is heavy, the others aren't
    got = periodic.lag_matches(w, 1500)
    assert all(got[q] == (w[:-q] == w[q:]).sum() for q in range(1, 1501))


def test_long_repeats_of_one_word_and_of_a_block():
    assert periodic.find_runs(np.zeros(30_000, int)) == [(0, 30_000, 1)]
    block = np.random.default_rng(3).integers(0, 400, 701)
    assert periodic.find_runs(np.concatenate([np.arange(1000, 1200), np.tile(block, 40)])) == [(200, 701 * 40, 701)]


def planted(doc_id, w):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = fast_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def fast_runs(w):
    """As brute_runs, with the islands of a lag found by one comparison."""
    number = {}
    a, out = np.array([number.setdefault(x, len(number)) for x in w], np.int64), {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (a[:-q] == a[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def test_query_is_brute_force_on_the_whole_table(spark, sf, documents):
    got = {tuple(r) for r in queries.queries()["op12_periodic_runs"](spark, sf).collect()}
    assert got == {plain_digest(r.doc_id, r.text) for r in documents.collect()}
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, odd, none):
    out = periodic.digest(periodic.periodic_runs(periodic.with_planted_repeats(odd)))
    want = [plain_digest(r.doc_id, r.text) for r in odd.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert periodic.digest(periodic.periodic_runs(none)).count() == 0


@pytest.mark.parametrize("n", [11, 12, 24])
def test_shortest_runs(spark, n):
    df = spark.createDataFrame([(1, "a b " * (n // 2) + "a" * (n % 2))], "doc_id long, text string")
    r = periodic.periodic_runs(df).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == ((n, [(0, n, 2)], "a b") if n >= 12 else (n, [], "a b a b a b a b a b a"))
