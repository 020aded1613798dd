"""Sentences compared with a sentence database by aligned words: matrix products of word vectors over groups of both."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .similar import stored

#: Sentences, and asked sentences, that meet in one task, about.
CHUNK, ASKED = 20_000, 100
#: Numbers of a matrix of words against words; longer sentences go through in pieces.
CELLS = 4_000_000
#: Digits that similarities are rounded to before they are ranked, so that the order of sums decides no rank.
DIGITS = 6


def _flat(rows: list[list[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, how often the word stood before in its sentence, and the sentence, of every word of the rows."""
    word, nth, owner = [], [], []
    for i, tokens in enumerate(rows):
        seen = Counter()
        for t in tokens:
            word.append(index[t])
            nth.append(seen[t])
            seen[t] += 1
        owner += [i] * len(tokens)
    return np.array(word, np.int64), np.array(nth, np.int64), np.array(owner, np.int64)


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(owner, prepend=-1))


def similarities(asked: list[list[str]], rows: list[list[str]], vectors: dict[str, np.ndarray], side: str = "short"):
    """(first row, matrix of asked sentences by rows from there on): aligned-word similarities, some rows at a time.

    The side that has fewer words (``short``) or more is the measure, the rows' where both have as many. Its words'
    best similarities with words of the other are averaged; common words, counted as often as both have them, count
    one. Words without a vector are like no word; a sentence without words is like all, 1.
    """
    index = {}
    for tokens in (*asked, *rows):
        for t in tokens:
            index.setdefault(t, len(index))
    width = max((len(v) for v in vectors.values()), default=1)
    units = np.zeros((len(index), width))
    for w, i in index.items():
        v = vectors.get(w)
        if v is not None and (length := np.sqrt(v @ v)) > 0:
            units[i] = v / length
    a_word, a_nth, a_owner = _flat(asked, index)
    b_word, b_nth, b_owner = _flat(rows, index)
    n_a, n_b = np.array([len(t) for t in asked]), np.array([len(t) for t in rows])
    ends = np.append(0, np.cumsum(n_b))
    a_starts = _starts(a_owner)
    a_rows = a_owner[a_starts]
    left = units[a_word]
    piece = max(64, CELLS // max(1, len(a_word)))
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + piece, "right")) - 1)
        best = np.full((len(a_word), last - first), -np.inf)  # of each asked word in each row
        back, common = np.zeros((2, len(asked), last - first))
        for p in range(ends[first], ends[last] if len(a_word) else ends[first], piece):
            at = slice(p, min(p + piece, ends[last]))
            starts = _starts(b_owner[at])
            cols = b_owner[at][starts] - first
            sim = left @ units[b_word[at]].T
            best[:, cols] = np.maximum(best[:, cols], np.maximum.reduceat(sim, starts, axis=1))
            put = np.ix_(a_rows, cols)
            back[put] += np.add.reduceat(np.maximum.reduceat(sim, a_starts, axis=0), starts, axis=1)
            same = (a_word[:, None] == b_word[at]) & (a_nth[:, None] == b_nth[at])
            common[put] += np.add.reduceat(np.add.reduceat(same.astype(np.int32), a_starts, axis=0), starts, axis=1)
        front = np.zeros_like(back)
        if len(a_word):
            front[a_rows] = np.add.reduceat(best, a_starts, axis=0)
        m, n = n_a[:, None], n_b[None, first:last]
        fewer, d = (m < n, np.minimum(m, n)) if side == "short" else (m > n, np.maximum(m, n))
        with np.errstate(all="ignore"):
            score = (np.where(fewer, front, back) / d * (d - common) + common) / d
        yield first, np.where(np.minimum(m, n) == 0, 1.0, score)
        first = last


def _best(asked: list[list[str]], rows: list[list[str]], vectors: dict[str, np.ndarray], k: int, side: str) -> list[list[tuple[float, str]]]:
    """The k best (-similarity, sentence) of each asked sentence, ties by the sentence."""
    kept = [[] for _ in asked]
    for first, part in similarities(asked, rows, vectors, side):
        part = np.round(part, DIGITS)
        least = np.partition(part, -k, axis=1)[:, -k] if part.shape[1] > k else np.full(len(asked), -np.inf)
        for i, own in enumerate(kept):
            own += [(-part[i, j], " ".join(rows[first + j])) for j in np.flatnonzero(part[i] >= least[i])]
            own.sort()
            del own[k:]
    return kept


def compare(sentences: DataFrame, asked: DataFrame, words: DataFrame, k: int, side: str = "short", tokens: str = "tokens") -> DataFrame:
    """(query, sentence, sim, copies, rank): the k sentences of a database most like each asked sentence.

    ``sentences`` and ``asked`` have words, without white space in them, in the column ``tokens``; ``words`` has (word,
    vec), one row a word. Similarity is that of :func:`similarities`, for every asked sentence with every sentence. Equal
    sentences are one row of the database, with their number in ``copies``, and one query; ties go by the sentence.
    Sentences are dealt by hash into chunks, asked ones into blocks, and one task compares a chunk with a block. Only the
    vectors of words that stand in either are brought there, each once, so a frequent word is no more rows than there
    are chunks and blocks. Null word lists are left out, null words too; other columns are ignored.
    """
    def distinct(df):
        rows = df.select(F.filter(tokens, lambda w: w.isNotNull()).alias("tokens")).where("tokens IS NOT NULL")
        return rows.groupBy("tokens").agg(F.count("*").alias("copies"))

    base, queries = stored(distinct(sentences), "sentences"), stored(distinct(asked).drop("copies"), "asked")
    chunks, blocks = -(-base.count() // CHUNK) or 1, -(-queries.count() // ASKED) or 1
    part = lambda n: F.pmod(F.xxhash64("tokens"), F.lit(n)).cast("int")
    of_chunk = base.select(part(chunks).alias("chunk"), "tokens")
    of_block = queries.select(part(blocks).alias("block"), "tokens")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vec = F.col("vec").cast("array<double>").alias("vec")

    def meet(df, key, other, n):
        """Rows of one side and vectors of their words, for every group of the other side."""
        none = F.lit(None).cast("array<double>").alias("vec")
        own = df.select(key, F.lit(key == "block").alias("asks"), "tokens", none)
        known = df.select(key, F.explode("tokens").alias("word")).distinct().join(words.select("word", vec), "word")
        both = own.unionByName(known.select(key, F.lit(None).cast("boolean").alias("asks"), F.array("word").alias("tokens"), "vec"))
        return both.withColumn(other, each(n)).select("chunk", "block", "asks", "tokens", "vec")

    def run(group: pa.Table) -> pa.Table:
        texts, vecs = group["tokens"].to_pylist(), group["vec"]
        asks = group["asks"].to_pylist()
        lut = {texts[i][0]: np.array(vecs[i].as_py(), float) for i, a in enumerate(asks) if a is None and vecs[i].is_valid}
        wanted, rows = ([t for t, a in zip(texts, asks) if a is is_asked] for is_asked in (True, False))
        found = [(" ".join(q), s, -d) for q, own in zip(wanted, _best(wanted, rows, lut, k, side)) for d, s in own]
        query, sentence, sim = zip(*found) if found else ((), (), ())
        return pa.table({"query": pa.array(query, pa.string()), "sentence": pa.array(sentence, pa.string()), "sim": pa.array(sim, pa.float64())})

    pairs = meet(of_chunk, "chunk", "block", blocks).unionByName(meet(of_block, "block", "chunk", chunks))
    near = pairs.groupBy("chunk", "block").applyInArrow(run, "query string, sentence string, sim double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "sentence"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(base.select(F.array_join("tokens", " ").alias("sentence"), "copies"), "sentence").select("query", "sentence", "sim", "copies", "rank")
