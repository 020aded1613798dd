import random
from pathlib import Path

import numpy as np
import pytest
import xxhash

from inkwell.llm import common, simhash

from .conftest import text_of


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprint_is_the_definition():
    for t in (None, "", "One", "one TWO", "a b c", "É é b\x0bc\x0cd", text_of(1, 300), "x " * 70_000):
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_query_against_brute_force(spark, documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    fp = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = plain_components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    got = simhash.simhash_components(documents).collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(i, f"{fp[i]:016x}", want[i]) for i in ids} and len(got) == len(ids)


@pytest.mark.parametrize("limit", [1, 48])
def test_links_in_small_and_large_blocks(spark, limit, monkeypatch):
    """A dense ball of fingerprints links alike by pairs and by midpoints."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(40)})
    want = plain_components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in links)
    assert plain_components([(unsigned(r.a), unsigned(r.b)) for r in links], fps) == want


def test_odd_rows(spark, odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id
    assert by[4].component_id == by[5].component_id == 4
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(common, "SMALL_GRAPH", small)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t):
    w = t.lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("limit", [2, 48])
def test_near_copies(spark, limit, monkeypatch):
    """Groups of edited copies are those of brute force at similarity 0.8."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng, rows = random.Random(5), []
    for g in range(12):
        base = text_of(100 + g, 150).split()
        for _ in range(rng.choice((1, 2, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2))):
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = plain_components([(a, b) for a in sets for b in sets if a < b and sim(a, b) >= 0.8], sets)
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_copies_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r.group_id for r in simhash.near_copies(odd).collect()}
    assert None not in got and got[1] == got[2] == got[3] == 1 and got[5] == 4 and got[12] == 11 and got[7] == 7
    assert simhash.near_copies(none).count() == 0


def test_short_texts_with_one_fingerprint_are_no_copies(spark):
    """Texts of one to five words are one shingle each: with thousands of them some fold to the same fingerprint."""
    rows = [(i, f"short text {i}") for i in range(1500)] + [(1500, "SHORT  text 7")]
    fps = simhash.wide_fingerprints([simhash._shingle_set(t.encode()) for _, t in rows[:1500]])
    assert len({x.tobytes() for x in fps}) < 1500
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(1500)} | {1500: 7}


def test_no_isolated_pair_at_the_threshold_is_lost(spark):
    """One edited word of 49 gives 40 shared of 50 shingles, exactly 0.8; of 48, just less. Each pair is on its own."""
    rows = []
    for i in range(300):
        for n in (49, 48):
            w = [f"w{i}n{n}p{k}" for k in range(n)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:24], "edited", *w[25:]]))]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - (i % 4 == 1) for i in range(1200)}


def test_links_inside_a_large_family(spark, monkeypatch):
    """A chain whose neighbours only are alike."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 2)
    monkeypatch.setattr(simhash, "CROWD", 5)
    w, rows = text_of(9, 200).split(), []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for k in range(3):
            w[(i * 15 + k * 5 + 2) % 200] = f"e{i}x{k}"
    sets = [shingle_set(t) for _, t in rows]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(sim(i, i + 1) >= 0.8 for i in range(39)) and all(sim(i, i + 2) < 0.8 for i in range(38))
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_crowded_keys_against_brute_force(spark, monkeypatch):
    """A family around 0.8 of many sizes, in pieces: all links and no other."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 6)
    monkeypatch.setattr(simhash, "CROWD", 40)
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(160)]
    for n in range(260):
        w = base[:rng.choice((30, 45, 110, 130, 160))]
        for at in rng.sample(range(3, len(w)), rng.randint(0, max(1, len(w) // 25))):
            w[at] = f"e{rng.randrange(10 ** 9)}"
        rows.append((n, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and sim(a, b) >= 0.8]
    want = plain_components(pairs, sets)
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(pairs) > 1000 and 5 < len(set(want.values())) < 200


def test_ids_may_be_structs(spark):
    rows = spark.createDataFrame([((False, 5), "a b c d e f"), ((True, 0), "a b c d e f"), ((False, 2), "other words here")], "id struct<none:boolean,n:long>, text string")
    got = {tuple(r.doc_id): tuple(r.group_id) for r in simhash.near_copies(rows, "id").collect()}
    assert got == {(False, 5): (False, 5), (True, 0): (False, 5), (False, 2): (False, 2)}


def test_sets_are_shuffled_in_turns_and_sketches_go(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:20]] + texts[20:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = []

    def spied(*parts):
        made.append((len(parts), common.materialize(*parts)))
        return made[-1][1]

    monkeypatch.setattr(simhash, "materialize", spied)
    found = {}
    for turns in (1, 4):
        monkeypatch.setattr(simhash, "TURNS", turns)
        made.clear()
        found[turns] = sorted(map(tuple, simhash.near_copies(docs).collect()))
        assert sorted(n for n, _ in made)[-2:] == [turns, turns]
        sketches = [t for _, t in made if {"doc_id", "fp", "keys"} <= set(t.columns)]
        assert len(sketches) == 1 and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in sketches[0].inputFiles())
    assert found[1] == found[4] and len({g for _, g in found[1]}) == 60
