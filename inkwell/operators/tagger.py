"""A part-of-speech tagger trained from tagged sentences: tag pairs, words and endings counted by Spark, best paths for whole batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk import TAGGED, _lists, tokenize

#: Words that the model knows by themselves, the most frequent ones; the others go by their endings.
WORDS = 200_000
#: Letters of the longest ending, and endings that the model knows.
ENDING, ENDINGS = 3, 50_000
#: Weight, in words, of what is expected without a word, an ending or a pair of tags.
PRIOR = 0.1
#: Sentences whose paths are followed together.
TOGETHER = 1_000


@dataclass(frozen=True)
class Tagger:
    """Scores in natural logarithms. It is called with the words of a sentence, as other taggers are."""

    tags: list[str]
    start: np.ndarray  # of the first tag
    step: np.ndarray  # of a tag (column) after another (row)
    words: dict[str, np.ndarray]  # how much more likely each tag is with the word than without
    endings: dict[str, np.ndarray]

    def score(self, word: str) -> np.ndarray:
        """Of each tag: the word's, as written or in lower case, or that of its longest known ending."""
        for w in (word, word.lower()):
            if w in self.words:
                return self.words[w]
        return next((self.endings[e] for n in range(ENDING, 0, -1) if (e := word.lower()[-n:]) in self.endings), np.zeros(len(self.tags)))

    def decode(self, sentences: list[list[str]]) -> list[list[str]]:
        """The most likely tags of every sentence; among equal paths the tags that come first decide, from the last word back."""
        out = [[] for _ in sentences]
        order = sorted((i for i, s in enumerate(sentences) if s), key=lambda i: -len(sentences[i]))
        seen = {}
        for at in range(0, len(order) if self.tags else 0, TOGETHER):
            some = order[at:at + TOGETHER]
            sizes = np.array([len(sentences[i]) for i in some])
            emit = lambda k, n: np.stack([seen[w] if (w := sentences[i][k]) in seen else seen.setdefault(w, self.score(w)) for i in some[:n]])  # noqa: E731, B023
            now, back = self.start + emit(0, len(some)), []
            for k in range(1, sizes[0]):
                n = int((sizes > k).sum())  # the longest sentences come first
                paths = now[:n, :, None] + self.step
                back.append(paths.argmax(1))
                now[:n] = paths.max(1) + emit(k, n)
            last = now.argmax(1)
            for j, i in enumerate(some):
                t, path = int(last[j]), []
                for k in range(sizes[j] - 1, 0, -1):
                    path.append(self.tags[t])
                    t = int(back[k - 1][j, t])
                out[i] = [*path, self.tags[t]][::-1]
        return out

    def __call__(self, words: list[str]) -> list[str]:
        return self.decode([words])[0]


def _most(counts: DataFrame, key: str, most: int) -> list:
    """(key, tag, n) of the most frequent keys, ties by the key."""
    kept = counts.groupBy(key).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), key).limit(most).select(key)
    return counts.join(kept, key).collect()


def train(sentences: DataFrame, col: str = "tagged", words: int = WORDS, endings: int = ENDINGS) -> Tagger:
    """A tagger from sentences of words with tags, as `parse_tags` gives them.

    Pairs of tags, words and endings of words are counted over all sentences, in tasks before the shuffle. The driver
    gets the pairs of tags and at most ``words`` words and ``endings`` endings, the most frequent, each with its tags:
    the model's size is set by these numbers, not by the sentences. A tag's score with a word is log P(tag | word) -
    log P(tag). Null sentences, words and tags are left out; without any sentence there are no tags, and results are empty.
    """
    own = F.filter(col, lambda x: x["word"].isNotNull() & x["tag"].isNotNull())
    rows = sentences.select(own.alias("s")).where(F.size("s") > 0)
    tags = F.transform("s", lambda x: x["tag"])
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.slice(tags, 1, F.size("s") - 1)).alias("before"), tags.alias("tag"))
    steps = rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.before").alias("before"), F.col("p.tag").alias("tag")).agg(F.count("*").alias("n")).collect()
    by_word = rows.select(F.explode("s").alias("x")).groupBy(F.col("x.word").alias("word"), F.col("x.tag").alias("tag")).agg(F.count("*").alias("n"))
    ends = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ENDING)), lambda k: F.right(F.lower("word"), k)))
    by_end = by_word.select(F.explode(ends).alias("end"), "tag", "n").where("end <> ''").groupBy("end", "tag").agg(F.sum("n").alias("n"))

    names = sorted({r.tag for r in steps})
    place = {t: i for i, t in enumerate(names)}
    size = len(names)
    start, step = np.zeros(size), np.zeros((size, size))
    for before, tag, n in steps:
        if before is None:
            start[place[tag]] += n
        else:
            step[place[before], place[tag]] += n
    share = (start + step.sum(0)) / max(1.0, start.sum() + step.sum())

    def scores(counts):
        sums = {}
        for key, tag, n in counts:
            sums.setdefault(key, np.zeros(size))[place[tag]] += n
        return {k: np.log((x + PRIOR * share) / (x.sum() + PRIOR)) - np.log(share) for k, x in sums.items()}

    smoothed = lambda x: np.log((x + PRIOR * share) / (x.sum(-1, keepdims=True) + PRIOR))
    return Tagger(names, smoothed(start), smoothed(step), scores(_most(by_word, "word", words)), scores(_most(by_end, "end", endings)))


def tag_trained(s: Column, tagger: Tagger, tokenizer: Callable[[str], list[str]] = tokenize) -> Column:
    """Words of a sentence with their tags, the paths of a batch followed together; null for null."""

    @F.arrow_udf(TAGGED)
    def run(rows: pa.Array) -> pa.Array:
        texts = rows.to_pylist()
        words = [tokenizer(t) if t is not None else [] for t in texts]
        tags = tagger.decode(words)
        words = [w if t else [] for w, t in zip(words, tags)]
        flat = [pa.array([x for own in part for x in own], pa.string()) for part in (words, tags)]
        return _lists([len(t) for t in tags], pa.StructArray.from_arrays(flat, ["word", "tag"]), [t is None for t in texts])

    return run(s)
