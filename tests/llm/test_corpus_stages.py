import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import decontam, mixing, quality, sharding
from inkwell.llm.queries import SHARDS, WEIGHTS, mixing_sql, sharding_sql

from .conftest import text_of

# Quality


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(docs, labels).join(labels.drop("toxic").withColumnRenamed("quality", "y"), "doc_id").collect()
    assert np.mean([r.keep == (r.y == 1) for r in got]) > 0.97 and sum(not r.keep for r in got if r.y == 1) <= 0.01 * len(got)


def test_quality_learns_from_some_and_holds_for_others():
    rng = random.Random(1)
    good = [text_of(i, rng.randint(20, 200)).encode() for i in range(120)]
    bad = [" ".join(w + rng.choice(("###", "%%%", "!!")) for w in text_of(i + 500, rng.randint(20, 200)).split()).encode() for i in range(60)]
    x = np.array([quality.document_features(t) for t in good + bad])
    y = np.array([1.0] * 120 + [0.0] * 60)
    w, b = quality.fit_logistic(x[::2], y[::2])
    z = np.hstack([x[1::2], x[1::2] ** 2]) @ w + b
    assert ((z > 0) == (y[1::2] == 1)).mean() > 0.97


def test_posteriors_shrink_sparse_sites(spark):
    rng = random.Random(3)
    rows = [("h1", "a", rng.uniform(0.7, 1))] * 1 + [("h1", "a", rng.uniform(0.7, 1)) for _ in range(400)] + [("h1", "b", 0.1)] + [("h2", "a", rng.uniform(0, 0.3)) for _ in range(400)] + [("h3", "a", 0.0)]
    sites, prior = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {(r.host, r.path): r for r in sites.collect()}
    assert by["h1", "a"].host_posterior > 0.8 and by["h2", "a"].host_posterior < 0.2
    assert 0 <= by["h3", "a"].host_posterior < prior.mean
    assert by["h1", "b"].path_posterior > 0.1 and by["h1", "b"].host_n == 402 and by["h1", "b"].path_n == 1


def plain_sites(rows):
    """Moments, strengths and posteriors with plain loops."""
    paths, hosts = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        paths[h, p].append(x), hosts[h].append(x)
    n, mean = len(rows), sum(r[2] for r in rows) / len(rows)
    within = sum((x - np.mean(v)) ** 2 for v in paths.values() for x in v) / max(1, n - len(paths))
    clip = lambda b: min(1000.0, max(1.0, within / b)) if b > 0 else 1000.0
    between = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within
    k_host = clip(between / (n - sum(len(v) ** 2 for v in hosts.values()) / n))
    host = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    off = sum(len(v) * (np.mean(v) - host[h]) ** 2 for (h, _), v in paths.items()) - (len(paths) - len(hosts)) * within
    k_path = clip(off / (n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())))
    return mean, k_host, k_path, host, {(h, p): (sum(v) + k_path * host[h]) / (len(v) + k_path) for (h, p), v in paths.items()}, hosts, paths


def test_posteriors_against_plain_sums(spark):
    """Hosts unlike each other, paths near their host's posterior: paths are shrunk more than hosts."""
    rng, rows = random.Random(5), []
    for h in range(12):
        level = rng.random()
        for p in range(rng.randint(1, 6)):
            rows += [(f"h{h}", f"p{p}", min(1.0, max(0.0, level + rng.gauss(0, 0.02) + rng.gauss(0, 0.2)))) for _ in range(rng.randint(1, 60))]
    sites, prior = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    mean, k_host, k_path, host, path, *_ = plain_sites(rows)
    assert tuple(prior) == pytest.approx((mean, k_host, k_path)) and k_path > 5 * k_host
    for r in sites.collect():
        assert r.host_posterior == pytest.approx(host[r.host]) and r.path_posterior == pytest.approx(path[r.host, r.path])


def test_quality_query_against_plain_version(spark):
    """All of op10: n-gram counts, features, evidence, posteriors without the document itself, and decisions."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    rows = [(r.doc_id, r.source or "", r.lang or "", (r.text or "").encode()) for r in docs.collect()]
    known, y = quality.Buckets(), {r.doc_id: r.quality for r in labels.collect()}
    size, held = 1 << quality.GRAM_BITS, {i: quality.Buckets().of(t) for i, _, _, t in rows}
    n, total = np.zeros((2, size)), [0, 0]
    for i, v in y.items():
        n[v, held[i]] += 1
        total[v] += 1
    x = []
    for i, _, _, t in rows:
        if i in y:
            own = np.eye(2)[y[i]]
            odds = [np.log((n[1, b] - own[1] + 1) / (total[1] - own[1] + 2)) - np.log((n[0, b] - own[0] + 1) / (total[0] - own[0] + 2)) for b in held[i]]
            x.append([*quality.document_features(t), float(np.mean(odds)) if odds else 0.0, y[i]])
    x = np.array(x, float)
    w, bias = quality.fit_logistic(x[:, :-1], x[:, -1])
    odds = np.log((n[1] + 1) / (total[1] + 2)) - np.log((n[0] + 1) / (total[0] + 2))
    z = {}
    for i, _, _, t in rows:
        f = np.array([*quality.document_features(t), odds[known.of(t)].mean() if len(held[i]) else 0.0])
        z[i] = min(12.0, max(-12.0, float(np.r_[f, f * f] @ w + bias)))
    p = {i: 1 / (1 + np.exp(-v)) for i, v in z.items()}
    mean, k_host, k_path, host, path, hosts, paths = plain_sites([(h, q, p[i]) for i, h, q, _ in rows])
    for i, h, q, _ in rows:
        others = (sum(hosts[h]) - p[i] + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        others = (sum(paths[h, q]) - p[i] + k_path * others) / (len(paths[h, q]) - 1 + k_path)
        want = 1 / (1 + np.exp(-(z[i] + np.log(others / (1 - others)) - np.log(mean / (1 - mean)))))
        assert got[i].evidence == pytest.approx(p[i], abs=1e-6) and got[i].path_posterior == pytest.approx(path[h, q], abs=1e-6)
        assert got[i].quality == pytest.approx(want, abs=1e-5) and got[i].keep == (want >= 0.5)


def test_labels_are_cut_by_hash(spark):
    """Of many labels only so many are taken, and the same ones however they come."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    one = sorted(r.t for r in quality.labelled(docs, labels, "doc_id", "text", 500).collect())
    two = sorted(r.t for r in quality.labelled(docs, labels.orderBy("quality").repartition(7), "doc_id", "text", 500).collect())
    assert len(one) == 500 and one == two
    many = docs.where("doc_id < 2").selectExpr("doc_id % 1 AS doc_id", "text").union(docs)  # repeated ids count once
    assert quality.labelled(many.union(many), labels, "doc_id", "text", 5000).count() == 3000


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (11, 1, 0), (10, 0, 0), (None, 1, 0), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.quality <= 1 for r in got)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.evidence for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


# Decontamination


def plain_hits(text, items):
    words, out = decontam.words_of(text), {}
    for item_id, item in items:
        own = decontam.words_of(item)
        if not own or not words:
            continue
        k = min(5, len(own))
        bag = Counter(decontam.shingles_of(own, k))
        length = min(len(own), len(words))
        if length < k:
            continue
        best = max((decontam.weighted_similarity(Counter(decontam.shingles_of(words[s:s + length], k)), bag), -s) for s in range(len(words) - length + 1))
        if best[0] >= 0.8:
            out[item_id] = (best[0], -best[1])
    return out


def test_leaks_against_all_windows(spark):
    rng, items = random.Random(2), [(i, text_of(700 + i, n)) for i, n in enumerate((15, 20, 20, 33, 47, 59, 6, 3, 200))]
    docs = []
    for i in range(60):
        own = text_of(i, rng.randint(0, 300)).split()
        for _, item in rng.sample(items, rng.choice((0, 0, 1, 2))):
            w = item.upper().split() if rng.random() < 0.5 else item.split()
            if len(w) > 40 and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = w
        docs.append((i, " ".join(own)))
    got = defaultdict(dict)
    for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[r.doc_id][r.item_id] = (r.similarity, r.start_word)
    want = {i: h for i, t in docs if (h := plain_hits(t, items))}
    assert {i: set(h) for i, h in got.items()} == {i: set(h) for i, h in want.items()}
    assert all(got[i][k][0] == pytest.approx(want[i][k][0]) for i in want for k in want[i])


def test_hamming_blocks_hold_all_within_radius():
    """Fingerprints within the radius are found, others aren't, and few items are candidates of a random one."""
    rng = np.random.default_rng(4)
    items = decontam.Items([(i, text_of(i, 30)) for i in range(60)])
    bits = 64 * decontam.LANES
    for n in range(300):
        flip, apart = np.zeros(bits, np.uint8), int(rng.integers(0, decontam.RADIUS + 9))
        flip[rng.choice(bits, apart, replace=False)] = 1
        own = n % 60
        asked = items.prints[own][None] ^ decontam._pack(flip[None].astype(bool))
        assert (own in items.near(0, asked)[1].tolist()) == (apart <= decontam.RADIUS)
    asked = rng.integers(0, 1 << 63, (200, decontam.LANES), dtype=np.int64).view(np.uint64)
    keys = decontam._block_keys(asked, np.zeros(200, np.int64), decontam.FLIPS[decontam.PROBED]).reshape(200, -1)
    met = sum(len(set(items.who[np.isin(items.posted, k)].tolist())) for k in keys)
    assert met < 0.2 * 200 * 60 and not len(items.near(0, asked)[0])


def test_leaks_at_the_edge_of_similarity():
    """Recall of the fingerprints: windows just at 0.8 or more, by all windows."""
    rng, held = random.Random(8), 0
    items = [(i, text_of(900 + i, rng.randint(45, 120))) for i in range(150)]
    index = decontam.Items(items)
    for item_id, item in items:
        w = item.split()
        for at in rng.sample(range(2, len(w) - 2), max(1, len(w) // 50)):
            w[at] = "other"
        text = " ".join([text_of(item_id, 40), *w, text_of(item_id + 7, 40)])
        want = plain_hits(text, [(item_id, item)])
        got = decontam.find_items(decontam.words_of(text), index)
        held += len(want)
        assert set(want) <= set(got)
    assert held > 50


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 2)
    items = [(i, text_of(i, 20)) for i in range(5)]
    docs = spark.createDataFrame([(9, " ".join(t for _, t in items))], "doc_id long, text string")
    assert sorted(r.item_id for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [0, 1, 2, 3, 4]


def test_odd_leaks(spark, odd, none):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (3, text_of(1, 60), 0), (4, text_of(3, 50), 0), (5, "!!", 0)], "item_id long, text string, doc_id int")
    got = decontam.contaminated(odd, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("4", 3), ("5", 3), ("None", 4)]
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [*((False, i) for i in (-3, 1, 2, 3, 6, 6, 7, 8, 9, 10, 11, 12)), (True, 0)]
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


# Mixing


def water(cap, weight, budget):
    """Shares by filling step by step."""
    share, open_ = dict.fromkeys(cap, 0.0), {k for k in cap if weight[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weight[k] for k in open_)
        full = {k for k in open_ if cap[k] - share[k] <= left * weight[k] / total + 1e-12}
        if not full:
            for k in open_:
                share[k] += left * weight[k] / total
            break
        for k in full:
            left -= cap[k] - share[k]
            share[k] = cap[k]
        open_ -= full
    return share


def test_shares_by_steps(spark):
    rng = random.Random(6)
    for _ in range(4):
        rows = [(g, f"c{i}", float(rng.choice((0, 5, 50, 500))), float(rng.choice((0, 1, 2, 7)))) for g in "xy" for i in range(6)]
        budget = {"x": rng.choice((10.0, 300.0, 5000.0)), "y": 123.0}
        df = spark.createDataFrame([(*r, budget[r[0]]) for r in rows], "g string, c string, cap double, w double, budget double")
        got = {(r.g, r.c): r.share for r in mixing.share_out(df, ["g"], "c").collect()}
        for g in "xy":
            want = water({r[1]: r[2] if r[3] else 0.0 for r in rows if r[0] == g}, {r[1]: r[3] for r in rows if r[0] == g}, budget[g])
            assert {c: got[g, c] for c in want} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("fraction", "epochs"), [(1.0, 3), (0.3, 1), (2.5, 3), (9.0, 2)])
def test_mix_against_brute_force(spark, documents, fraction, epochs):
    got = {r.doc_id: r for r in mixing.mix(documents, WEIGHTS, fraction, epochs).collect()}
    rows = {r.doc_id: (r.domain, r.lang, r.source, r.tokens) for r in got.values()}
    leaf = Counter()
    for d, lang, s, t in rows.values():
        leaf[d, lang, s] += t
    for r in documents.collect():
        assert rows[r.doc_id][1:] == (r.lang, r.source, len(r.text.encode().split()))

    def split(parents, depth, budgets):
        out = {}
        for p in parents:
            kids = {k[:depth + 1] for k in leaf if k[:depth] == p}
            cap = {k: sum(v for x, v in leaf.items() if x[:depth + 1] == k) * epochs for k in kids}
            w = {k: WEIGHTS.get(mixing.LEVELS[depth], {}).get(k[depth], 1) for k in kids}
            out |= water(cap, w, budgets[p])
        return out

    budgets = {(): int(sum(leaf.values()) * fraction)}
    for depth in range(3):
        budgets = split(list(budgets), depth, budgets)
    for key, budget in budgets.items():
        budget, own = int(budget + 1e-6), [i for i in rows if rows[i][:3] == key]
        full = budget // leaf[key] if leaf[key] else 0
        left, run = budget - full * leaf[key], 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"7:{full}:{i}".encode()).hexdigest()):
            run += rows[i][3]
            assert got[i].copies == full + (run <= left), key


def test_mix_of_odd_rows(spark, odd, none):
    got = mixing.mix(odd, WEIGHTS).collect()
    assert len(got) == odd.count() and all(r.copies >= 0 and r.lang is not None and r.source is not None for r in got)
    assert mixing.mix(none, WEIGHTS).count() == 0


# Sharding


@pytest.mark.parametrize("slots", [7, 101, 65537])
def test_table_is_even_and_stable(slots):
    names = tuple(f"s{i}" for i in range(7))
    table = sharding.fill_table(names, slots)
    n = Counter(table)
    assert len(table) == slots and max(n.values()) - min(n.values()) <= 1 and len(n) == 7
    if slots > 1000:
        less = sharding.fill_table(names[:-1], slots)
        moved = sum(a != b for a, b in zip(table, less) if a != 6)
        assert moved < 0.1 * slots


def test_table_by_preference_lists():
    names, slots = ("a", "b", "c"), 13
    orders = [[(sharding._digest("offset:" + s) + i * (sharding._digest("skip:" + s) % (slots - 1) + 1)) % slots for i in range(slots)] for s in names]
    table, turn = {}, 0
    while len(table) < slots:
        table[next(x for x in orders[turn % 3] if x not in table)] = turn % 3
        turn += 1
    assert sharding.fill_table(names, slots) == tuple(table[i] for i in range(slots))


@pytest.mark.parametrize(("names", "slots"), [((), 7), (("a", "a"), 7), (("a",), 8), (("a", "b", "c"), 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(names, slots)


def test_sharding_of_odd_rows(spark, odd, none, tmp_path):
    got = sharding.assign_shards(odd, SHARDS)
    assert got.columns == [c for c in odd.columns if c != "shard"] + ["shard"] and got.count() == odd.count()
    assert len({r.shard for r in got.collect() if r.doc_id == 6}) == 1 and all(0 <= r.shard < 64 for r in got.collect())
    assert sharding.assign_shards(none, SHARDS).count() == 0
    assert "Exchange hash" not in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()
    sharding.write_shards(odd.drop("shard"), f"file://{tmp_path}/out", SHARDS)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == odd.count()


def test_sql_twins(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    from inkwell.llm import queries

    for name, sql in (("op7_sharding", sharding_sql()), ("op5_mixing", mixing_sql())):
        df = queries.queries()[name](spark, sf)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())
