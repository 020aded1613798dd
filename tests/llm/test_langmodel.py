import math
import zlib
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import langmodel as L


def plain(rows):
    """Base and model scores with unrounded counts and probabilities but for the documented quantised counts."""
    tok = [(i, [w.decode() for w in (t or "").encode().lower().split()] + [" "]) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in tok]
    c = Counter(w for (_, ws), h in zip(tok, held) if not h for w in ws)
    b = Counter(p for (_, ws), h in zip(tok, held) if not h for p in zip([" ", *ws], ws))
    n, v = sum(c.values()), len(c)
    m = {w: 2 ** (round(8 * math.log2(x)) / 8) - 0.75 for w, x in c.items()}
    unseen = 0.75 * v / n
    p1 = lambda w: m[w] * (1 - unseen) / sum(m.values()) if w in c else unseen
    out = []
    for (i, ws), h in zip(tok, held):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = sum(math.log10((b[a, w] + L.PRIOR * p1(w)) / (c[a] + L.PRIOR)) for a, w in zip([" ", *ws], ws))
        out.append((str(i), h, len(ws), sum(w in c for w in ws), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, documents, odd, small, monkeypatch):
    if small:  # many batches and shards, contexts split by word
        monkeypatch.setattr(L, "BATCH_BYTES", 20_000)
        monkeypatch.setattr(L, "SHARD_WORDS", 500)
        monkeypatch.setattr(L, "SHARD_GRAMS", 2000)
    rows = documents.select("doc_id", "text").limit(60).union(odd.select("doc_id", "text"))
    got = sorted((str(r[0]), *r[1:]) for r in L.score_texts(rows).collect())
    for g, w in zip(got, plain([(r[0], r[1]) for r in rows.collect()]), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and abs(g[6] - w[6]) <= 2e-4 * g[2]


def test_no_rows_and_nothing_to_learn_from(spark, none):
    assert L.score_texts(none).count() == 0
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = L.score_texts(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.base_score == 0


@pytest.mark.parametrize("n", [0, 1, 5, 70_000, 200_000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, 1 << 34, n).astype(np.uint64))
    e = L.EliasFano(x)
    got = [e.block(k) for k in range(len(e.starts))]
    assert np.array_equal(np.concatenate(got) if got else np.zeros(0, np.uint64), x)
    asked = np.sort(np.concatenate([x[::7], rng.integers(0, 1 << 35, 100).astype(np.uint64)]))
    place, equal = e.successor(asked)
    assert np.array_equal(place, np.searchsorted(x, asked)) and np.array_equal(equal, np.isin(asked, x))
    if n > 1000:
        assert e.size * 8 < n * (3 + np.log2((1 << 34) / n))


def test_trie_finds_all_and_only_its_grams():
    rng = np.random.default_rng(1)
    grams = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (5000, 2))})
    asked = sorted({(int(a), int(b)) for a, b in rng.integers(0, 320, (5000, 2))} | set(grams[:100]))
    code = np.arange(len(grams)).astype(np.uint16)
    trie = L.Trie(np.array([g[0] for g in grams]), np.array([g[1] for g in grams]), code)
    got, found = trie.find(np.array([g[0] for g in asked]), np.array([g[1] for g in asked]))
    want = {g: i for i, g in enumerate(grams)}
    assert [(bool(f), int(x)) for f, x in zip(found, got)] == [(g in want, want.get(g, 0)) for g in asked]


def test_probabilities_sum_to_one(spark):
    """Over seen words and one unseen word, in a seen and an unseen context."""
    n = Counter("a b a c a b d".split())
    code = L.count_code(np.array(list(n.values())))
    unseen = 0.75 * len(n) / sum(n.values())
    p1 = L.mass(code) * (1 - unseen) / L.mass(code).sum()
    assert p1.sum() + unseen == pytest.approx(1)
