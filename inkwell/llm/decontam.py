"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle check."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, tidy

SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a fingerprint, and its blocks of 16 bits.
LANES = 3
BLOCKS = 4 * LANES
#: Bits of a block that may differ: so many among an item's postings and so many among a window's probes.
POSTED, PROBED = 2, 1
#: A pair within this radius has a block within POSTED + PROBED. At similarity 0.8 about 29 of 192 bits differ, give or take 5.
RADIUS = BLOCKS * (POSTED + PROBED + 1) - 1
#: Benchmark items, and characters of them, that are held in an executor at once; a larger table is taken in blocks.
ITEM_BLOCK, ITEM_CHARS = 5_000, 16 << 20
#: Windows looked up at once.
WINDOWS = 4096

#: Lower-case A-Z; ASCII marks count as spaces.
FOLD = bytes(c + 32 if 65 <= c < 91 else 32 if 33 <= c < 127 and not chr(c).isalnum() else c for c in range(256))

#: All 16-bit words with at most so many ones.
FLIPS = [np.array([0, *(sum(1 << i for i in c) for k in range(1, n + 1) for c in combinations(range(16), k))], np.uint16) for n in range(3)]
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in any case, marks left out."""
    return (text or "").lower().encode("utf-8", "replace").translate(FOLD).split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    return [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of smaller weights over sum of larger ones; a shingle's weight is how often it occurs."""
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


class Items:
    """A block of benchmark items, indexed by shingle, and by the Hamming blocks of the items of each size."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        #: (k, words) -> number of the size, by which fingerprints are told apart in the index
        self.sizes: dict[tuple[int, int], int] = {}
        keys, own = defaultdict(list), []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            k = min(SHINGLE, len(words))
            bag = Counter(shingles_of(words, k))
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            for key in np.unique(gram_keys(ids, k)).tolist():
                keys[k].append((key, len(words)))
            own.append(self.sizes.setdefault((k, len(words)), len(self.sizes)))
            self.items.append((item_id, bag))
        self.keys = {k: self._by_key(v) for k, v in keys.items()}
        self.prints = np.array([sum_fingerprint(bag) for _, bag in self.items], np.uint64).reshape(-1, LANES)
        posted = _block_keys(self.prints, np.array(own, np.int64), FLIPS[POSTED])
        self.who = np.repeat(np.arange(len(self.items), dtype=np.int32), BLOCKS * len(FLIPS[POSTED]))
        order = np.argsort(posted, kind="stable")
        self.posted, self.who = posted[order], self.who[order]

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size that share a key of the index, thus all within RADIUS, and are within it."""
        asked = _block_keys(prints, np.full(len(prints), size), FLIPS[PROBED])
        lo, hi = np.searchsorted(self.posted, asked, "left"), np.searchsorted(self.posted, asked, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        at = np.repeat(lo[hit] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        row = np.repeat(hit // (BLOCKS * len(FLIPS[PROBED])), n)
        pairs = np.unique(row * len(self.items) + self.who[at])
        row, item = pairs // max(1, len(self.items)), pairs % max(1, len(self.items))
        close = np.bitwise_count(prints[row] ^ self.prints[item]).sum(1, dtype=np.int64) <= RADIUS
        return row[close], item[close]

    @staticmethod
    def _by_key(pairs):
        by = defaultdict(set)
        for key, size in pairs:
            by[key].add(size)
        seen = np.array(sorted(by), np.uint64)
        return seen, [sorted(by[k]) for k in seen.tolist()]


def _block_keys(prints: np.ndarray, size: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Index keys of fingerprints: size, block and the block's bits, with each set of flips."""
    bits = prints.view(np.uint16).reshape(-1, BLOCKS, 1) ^ flips
    return ((size[:, None, None] * BLOCKS + np.arange(BLOCKS)[None, :, None] << 16) + bits).ravel()


def gram_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of each run of k word ids."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ ids[j:len(ids) - k + 1 + j]) * SPREAD
            out ^= out >> np.uint64(29)
    return out


def _bits(shingles) -> np.ndarray:
    """(shingles, 64 * LANES): the hash bits of each shingle."""
    raw = b"".join(xxhash.xxh3_128_digest(s) + xxhash.xxh64_digest(s) for s in shingles)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * LANES), axis=1)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64).reshape(-1, LANES)


def sum_fingerprint(bag: Counter) -> np.ndarray:
    """Weighted SimHash of a bag of shingles, as LANES words."""
    n = np.array(list(bag.values()), np.int64)
    return _pack((2 * (n @ _bits(bag).astype(np.int64)) > n.sum())[None])[0]


def find_items(words: list[bytes], items: Items) -> dict[int, tuple[float, int, int]]:
    """item_id -> (similarity, first word, words) of the best window of the item's size.

    A window can only be similar if it has a shingle of the block's items, so windows around such shingles are
    fingerprinted, all others being at similarity zero. A text shorter than an item is one window.
    """
    found: dict[int, tuple[float, int, int]] = {}
    get = items.vocabulary.get
    ids = np.array([get(w, 0) for w in words], np.uint64)
    for k, (keys, sizes) in items.keys.items():
        if len(ids) < k:
            continue
        grams = gram_keys(ids, k)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        hits = np.flatnonzero(keys[at] == grams)
        if not len(hits):
            continue
        reach = defaultdict(list)
        for p, which in zip(hits.tolist(), at[hits].tolist()):
            for size in sizes[which]:
                reach[size].append(p)
        for size, places in reach.items():
            _search(words, k, size, np.array(places), items, found)
    return found


def _search(words, k, size, places, items, found):
    grams, length = len(words) - k + 1, min(size, len(words))
    width, last = length - k + 1, len(words) - length
    cut = np.flatnonzero(np.diff(places) > 2 * width) + 1
    for group in np.split(places, cut):
        lo, hi = max(0, int(group[0]) - width + 1), min(last, int(group[-1]))
        end = min(grams, hi + width)
        local = shingles_of(words[lo:end + k - 1], k)
        starts = np.arange(lo, hi + 1)
        near = np.zeros(grams + 1, np.int64)
        np.add.at(near, group + 1, 1)
        near = np.cumsum(near)
        starts = starts[near[starts + width] > near[starts]]
        for part in np.split(starts, range(WINDOWS, len(starts), WINDOWS)):
            first = int(part[0]) - lo
            total = np.zeros((int(part[-1]) - lo + width - first + 1, 64 * LANES), np.int32)
            np.cumsum(_bits(local[first:first + len(total) - 1]), axis=0, out=total[1:])
            at = part - lo - first
            prints = _pack(2 * (total[at + width] - total[at]) > width)
            for row, m in zip(*(x.tolist() for x in items.near(items.sizes[k, size], prints))):
                item_id, bag = items.items[m]
                s = int(part[row])
                alike = weighted_similarity(Counter(local[s - lo:s - lo + width]), bag)
                if alike >= SIMILARITY and alike > found.get(item_id, (0.0,))[0]:
                    found[item_id] = (alike, s, length)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): every benchmark item that a document holds.

    A window of as many words as the item, anywhere in the whole text, holds it at a weighted five-word shingle
    similarity of 0.8 or more; the best window is reported, the first of equals. Case and ASCII marks don't count.
    Items of fewer than five words are one shingle; items and texts that are null or without words hold nothing.
    Repeated rows give repeated results; empty tables give an empty result; other columns are ignored. A very long
    text is searched whole, WINDOWS windows at a time.

    Windows without any shingle of the benchmark are at similarity zero and aren't fingerprinted. Of the others, the
    index finds all within RADIUS bits of an item of their size. The items are the query set: ITEM_BLOCK of them, of
    ITEM_CHARS characters in all, go to the executors at a time, each block in one narrow pass without a shuffle.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for block in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(shared.value)
            for b in slices(batches):
                made = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text:
                        made += [(doc_id, i, *x) for i, x in sorted(find_items(words_of(text), items).items())]
                cols = list(zip(*made)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        hits = src.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, start_word int, n_words int")
        out = hits if out is None else out.union(hits)
    return out


def _item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text), at least one; rows without either are no items. An item larger than ITEM_CHARS is a block of its own."""
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    block, room = [], ITEM_CHARS
    for item_id, text in asked.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) == ITEM_BLOCK or len(text) > room):
            yield block
            block, room = [], ITEM_CHARS
        block.append((item_id, text))
        room -= len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, by the rules of ``contaminated``.

    Rows are judged by their text alone, in one narrow pass for each block of items: ids may be null or repeated, and
    nothing is shuffled. Rows with null or empty text stay.
    """
    out = docs
    for block in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(shared.value)
            for b in slices(batches):
                clean = [not t or not find_items(words_of(t), items) for t in b.column(b.num_columns - 1).to_pylist()]
                yield b.select(range(b.num_columns - 1)).filter(pa.array(clean, pa.bool_()))

        out = out.select("*", F.col(text_col).cast("string").alias(fresh(docs, "text_of_row")[0])).mapInArrow(tidy(run), docs.schema)
    return out
