"""The trained tagger against every path by brute force, and on sentences it hasn't seen."""

from collections import Counter
from itertools import product
from math import log

import numpy as np
import pytest

from inkwell.operators import chunk, tagger
from pyspark.sql import functions as F

LINES = ["the/DT dog/NN runs/VBZ", "a/DT cat/NN sleeps/VBZ quietly/RB", "the/DT old/JJ dog/NN barks/VBZ loudly/RB", "dogs/NNS run/VBP", "the/DT run/NN was/VBD long/JJ",
         "cats/NNS sleep/VBP", "a/DT long/JJ run/NN ends/VBZ", "", "he/PRP runs/VBZ and/or/CC sleeps/VBZ"]


@pytest.fixture(scope="module")
def trained(spark):
    lines = spark.createDataFrame([(x,) for x in LINES] + [(None,)], "line string").select(chunk.parse_tags(F.col("line")).alias("tagged"))
    return tagger.train(lines)


def test_counts_and_scores(trained):
    """Scores of starts, steps, words and endings, reckoned one by one."""
    sentences = [[tuple(w.rsplit("/", 1)) for w in x.split()] for x in LINES if x]
    tags = Counter(t for s in sentences for _, t in s)
    total, at = sum(tags.values()), trained.tags.index
    assert trained.tags == sorted(tags)
    share = {t: n / total for t, n in tags.items()}
    first = Counter(s[0][1] for s in sentences)
    after = Counter((a[1], b[1]) for s in sentences for a, b in zip(s, s[1:]))
    left = Counter(a[1] for s in sentences for a in s[:-1])
    word = Counter(x for s in sentences for x in s)
    end = Counter((w[-1:], t) for s in sentences for w, t in s)
    for t in tags:
        assert trained.start[at(t)] == pytest.approx(log((first[t] + 0.1 * share[t]) / (len(sentences) + 0.1)))
        for u in tags:
            assert trained.step[at(t), at(u)] == pytest.approx(log((after[t, u] + 0.1 * share[u]) / (left[t] + 0.1)))
        assert trained.words["run"][at(t)] == pytest.approx(log((word["run", t] + 0.1 * share[t]) / (sum(word["run", u] for u in tags) + 0.1)) - log(share[t]))
        assert trained.endings["s"][at(t)] == pytest.approx(log((end["s", t] + 0.1 * share[t]) / (sum(end["s", u] for u in tags) + 0.1)) - log(share[t]))


def test_best_of_all_paths(trained):
    """Of all paths none is better; sentences of several lengths together give what each gives alone."""
    asked = [["the", "run", "ends"], ["dogs", "run", "loudly"], [], ["Zebras"], ["run", "Run"], ["the", "zzz", "sleeps", "quietly"]]
    index = range(len(trained.tags))
    got = trained.decode(asked)
    for words, tags in zip(asked, got):
        value = lambda p: sum((trained.step[a, b] for a, b in zip(p, p[1:])), trained.start[p[0]]) + sum(trained.score(w)[t] for w, t in zip(words, p))  # noqa: E731, B023
        assert len(words) == len(tags) and tags == trained(words)
        if words:
            assert value([trained.tags.index(t) for t in tags]) == pytest.approx(max(value(p) for p in product(index, repeat=len(words))))
    assert got[0] == ["DT", "NN", "VBZ"] and got[1] == ["NNS", "VBP", "RB"]


def test_learns_what_it_is_given(spark, monkeypatch):
    """Tags of the default tagger, learned from sentences, hold on other sentences with new words; limits leave endings."""
    monkeypatch.setattr(tagger, "TOGETHER", 7)
    rng = np.random.default_rng(1)
    stems = ["walk", "jump", "call", "help", "play", "turn", "wait", "open"]
    make = lambda some: " ".join([str(rng.choice(["the", "a", "this"])), str(rng.choice(some)) + "able", "house", "can", str(rng.choice(some)) + "ing", "very", str(rng.choice(some)) + "ly"])
    lines = spark.createDataFrame([(make(stems[:5]),) for _ in range(80)], "s string").select(chunk.tag(F.col("s")).alias("tagged"))
    others = spark.createDataFrame([(make(stems[5:]),) for _ in range(40)], "s string")
    for model in (tagger.train(lines), tagger.train(lines, words=8)):
        assert len(model.words) == 8 or len(model.words) > 15
        both = others.select(tagger.tag_trained(F.col("s"), model).alias("a"), chunk.tag(F.col("s")).alias("b"), chunk.tag_all(F.col("s"), {"trained": model, "rules": chunk.rule_tagger}).alias("c")).collect()
        same = [x.tag == y.tag for r in both for x, y in zip(r.a, r.b, strict=True)]
        assert sum(same) >= 0.95 * len(same) and all(r.c.trained == r.a and r.c.rules == r.b for r in both)


def test_nothing_to_learn_or_tag(spark, trained):
    none = tagger.train(spark.createDataFrame([], f"tagged {chunk.TAGGED}"))
    rows = spark.createDataFrame([("a dog",), ("",), (None,), ("word " * 20_000,)], "s string")
    assert [r.t for r in rows.select(tagger.tag_trained(F.col("s"), none).alias("t")).collect()] == [[], [], None, []]
    assert [r.n for r in rows.select(F.size(tagger.tag_trained(F.col("s"), trained)).alias("n")).collect()] == [2, 0, None, 20_000]
