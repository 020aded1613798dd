"""Language-model scoring with an Elias-Fano n-gram trie in shards."""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .langid import held_out

#: Bytes of text that are tokenized together.
BATCH_BYTES = 6 << 20
#: Words, and bigram occurrences, that a shard holds on average.
SHARD_WORDS, SHARD_GRAMS = 2_000_000, 2_000_000
#: Taken from every seen word's count for unseen ones, and the weight of the unigram model in counts of the context.
DISCOUNT, PRIOR = 0.75, 200.0
#: Steps of a quantised count in an octave, and of a quantised probability in a power of ten.
COUNT_STEPS, PROB_STEPS = 8, 4096
#: The end of a text as a token, and the context of a first word. A space is no word.
END = xxhash.xxh64_intdigest(b" ")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in order: a count, a type letter and a length for each, then their bytes, compressed."""
    head = bytes([len(arrays)]) + b"".join(x.dtype.char.encode() + len(x).to_bytes(5, "little") for x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, out = zstandard.ZstdDecompressor().decompress(blob), []
    at = 1 + 6 * data[0]
    for i in range(1, at, 6):
        kind, n = np.dtype(chr(data[i])), int.from_bytes(data[i + 1:i + 6], "little")
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence, from zero."""
    return np.diff(x, prepend=x.dtype.type(0))


def _least(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the fewest bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


# The trie


class EliasFano:
    """A rising sequence in about 2 + log2(universe / n) bits each, in an anonymous memory map.

    Each number's low bits are packed one after the other; its high part is a one in a bit string, at high + place.
    """

    BLOCK = 1 << 16

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        ones = high + np.arange(self.n)
        upper = np.zeros((int(ones[-1]) + 1 if self.n else 0) + 7 >> 3, np.uint8)
        np.bitwise_or.at(upper, ones >> 3, (128 >> (ones & 7)).astype(np.uint8))
        parts = []
        for i in range(0, self.n, self.BLOCK):
            v = values[i:i + self.BLOCK]
            bits = (v[:, None] >> np.arange(self.low - 1, -1, -1, dtype=np.uint64)).astype(np.uint8) & 1
            parts.append(np.packbits(bits.ravel()))
        lower = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        #: Where each block of numbers begins in the bit string, and its first high part.
        self.starts = ones[::self.BLOCK].copy()
        self.firsts = values[::self.BLOCK].copy()
        self.size = len(upper) + len(lower)
        self.map = mmap.mmap(-1, max(1, self.size))
        self.map[:self.size] = upper.tobytes() + lower.tobytes()
        self.cut = len(upper)

    def block(self, k: int) -> np.ndarray:
        """The numbers of block k."""
        i, j = k * self.BLOCK, min(self.n, (k + 1) * self.BLOCK)
        start = int(self.starts[k])
        end = int(self.starts[k + 1]) if k + 1 < len(self.starts) else 8 * self.cut
        raw = np.frombuffer(self.map, np.uint8, (end + 7 >> 3) - (start >> 3), start >> 3)
        ones = np.flatnonzero(np.unpackbits(raw)[start & 7:])[:j - i] + start
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            at = self.cut + k * (self.BLOCK * self.low >> 3)
            size = (j - i) * self.low + 7 >> 3
            bits = np.unpackbits(np.frombuffer(self.map, np.uint8, size, at))[:(j - i) * self.low].reshape(-1, self.low)
            wide = np.zeros((j - i, -(-self.low // 8) * 8), np.uint8)
            wide[:, wide.shape[1] - self.low:] = bits
            low = np.zeros(j - i, np.uint64)
            for byte in np.packbits(wide, axis=1).T:
                low = low << np.uint64(8) | byte
            out |= low
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """Numbers at rising places."""
        out = np.zeros(len(places), np.uint64)
        for k in range(len(self.starts)):
            a, b = np.searchsorted(places, (k * self.BLOCK, (k + 1) * self.BLOCK))
            if a < b:
                out[a:b] = self.block(k)[places[a:b] - k * self.BLOCK]
        return out

    def successor(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not below each of the rising ``asked``, and whether it is equal."""
        place, equal = np.full(len(asked), self.n), np.zeros(len(asked), bool)
        edges = np.searchsorted(asked, self.firsts)
        for k in range(len(self.starts)):
            a, b = edges[k] if k else 0, edges[k + 1] if k + 1 < len(edges) else len(asked)
            if a < b:
                v = self.block(k)
                at = np.searchsorted(v, asked[a:b])
                place[a:b] = at + k * self.BLOCK
                inside = at < len(v)
                equal[a:b] = inside & (v[np.minimum(at, len(v) - 1)] == asked[a:b])
        return place, equal


class Trie:
    """Contexts, pointers to their successors, and successors with quantised probabilities.

    Successors are stored relative to the context: in its range each is raised by the last number of the range
    before, so that the whole level rises. Gram (context, word) pairs come sorted and distinct.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray):
        own, first = np.unique(context, return_index=True)
        last = np.append(first[1:], len(word)) - 1
        base = np.zeros(len(own), np.uint64)
        if len(own):
            base[1:] = np.cumsum(word[last].astype(np.uint64) + np.uint64(1))[:-1]
        self.contexts = EliasFano(own)
        self.pointers = EliasFano(np.append(first, len(word)))
        self.words = EliasFano(word.astype(np.uint64) + np.repeat(base, np.diff(np.append(first, len(word)))))
        self.map = mmap.mmap(-1, max(1, code.nbytes))
        self.map[:code.nbytes] = code.tobytes()
        self.code = np.frombuffer(self.map, code.dtype, len(code))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised probability of each of the sorted (context, word) pairs and whether the trie has it."""
        if not len(context) or not self.contexts.n:
            return np.zeros(len(context), self.code.dtype), np.zeros(len(context), bool)
        rank, known = self.contexts.successor(context)
        out, found = np.zeros(len(context), self.code.dtype), np.zeros(len(context), bool)
        rank, asked = rank[known], word[known].astype(np.uint64)
        if not len(rank):
            return out, found
        ends = self.pointers.at(np.arange(self.contexts.n + 1)).astype(np.int64)
        base = np.zeros(self.contexts.n, np.uint64)
        base[1:] = self.words.at(ends[1:-1] - 1) + np.uint64(1)
        place, equal = self.words.successor(np.minimum(asked, self._last(ends, base)[rank] + np.uint64(1)) + base[rank])
        equal &= (place < ends[rank + 1]) & (place >= ends[rank])
        hit = np.flatnonzero(known)[equal]
        out[hit], found[hit] = self.code[place[equal]], True
        return out, found

    def _last(self, ends, base):
        """Largest successor of each context: a larger word is asked for as one past it, so that queries rise too."""
        return self.words.at(ends[1:] - 1) - base


# Counting and scoring


def tokenize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Batches of texts: documents, their numbers of tokens, all tokens as local numbers, and the words' hashes.

    Words are numbered in the order of their hashes, END among them; each text ends in END.
    """

    def batch(ids, held, texts, number):
        vocabulary: dict[bytes, int] = {}
        stream, size = [], []
        for t in texts:
            words = t.lower().split()
            stream += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            stream.append(-1)
            size.append(len(words) + 1)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        h = np.append(h, np.uint64(END))
        order, rank = np.argsort(h), np.empty(len(h), np.uint32)
        rank[order] = np.arange(len(h))
        tokens = rank[np.array(stream, np.int64)]
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
            pa.array([size], pa.list_(pa.int32())), pa.array([_pack(_least(tokens))]), pa.array([_pack(_gaps(h[order]))]),
            pa.array([len(h)]), pa.array([len(tokens)]), pa.array([int(rank[-1])])], ["batch", "ids", "held", "size", "tokens", "words", "n_words", "n_tokens", "end"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, room = [], [], [], BATCH_BYTES
        for b in batches:
            for i, x, t in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i), held.append(x), texts.append(t or b"")
                room -= len(texts[-1])
                if room <= 0:
                    yield batch(ids, held, texts, number)
                    number, ids, held, texts, room = number + 1, [], [], [], BATCH_BYTES
        if ids:
            yield batch(ids, held, texts, number)

    src = docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col), 5), F.encode(text_col, "UTF-8"))
    return src.mapInArrow(run, "batch long, ids array<long>, held array<boolean>, size array<int>, tokens binary, words binary, n_words long, n_tokens long, end long")


def _rows(cols, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def count_words(batches: DataFrame, shards: int) -> DataFrame:
    """Word counts over all training texts, by ranges of hashes, sent back to each batch that asked.

    (shard, batch, blob): the count of each of a batch's words in the shard and its place among the shard's words. A row
    with a null batch holds the shard's sums: tokens, seen words, all words, quantised mass.
    """
    bits = shards.bit_length() - 1

    def ask(rows):
        for b in rows:
            for batch, held, size, tokens, words in zip(*(b.column(i).to_pylist() for i in range(5))):
                h, t = np.cumsum(_unpack(words)[0], dtype=np.uint64), _unpack(tokens)[0]
                n = np.bincount(t[np.repeat(~np.array(held, bool), size)], minlength=len(h))
                at = np.searchsorted(h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64), np.arange(shards + 1))
                parts = [(s, _pack(_gaps(h[i:j]), _least(n[i:j]))) for s, (i, j) in enumerate(zip(at, at[1:])) if i < j]
                yield _rows([[s for s, _ in parts], [batch] * len(parts), [x for _, x in parts]], ["shard", "batch", "blob"], (pa.int32(), pa.int64(), pa.binary()))

    def answer(table):
        shard = table.column("shard")[0].as_py()
        asked = [_unpack(x) for x in table.column("blob").to_pylist()]
        hashes = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
        own, place = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(place, np.concatenate([x[1] for x in asked]).astype(np.float64), len(own)).astype(np.int64)
        out, at = [_pack(np.array([n.sum(), (n > 0).sum(), len(own)], np.int64), mass(count_code(n)).sum(keepdims=True))], 0
        for h in hashes:
            p = place[at:at + len(h)]
            out.append(_pack(_least(n[p]), _least(_gaps(p))))
            at += len(h)
        return pa.table({"shard": pa.array([shard] * len(out), pa.int32()), "batch": pa.array([None, *table.column("batch").to_pylist()], pa.int64()), "blob": pa.array(out, pa.binary())})

    kinds = "shard int, batch long, blob binary"
    return batches.select("batch", "held", "size", "tokens", "words").mapInArrow(ask, kinds).groupBy("shard").applyInArrow(answer, kinds)


def count_code(n: np.ndarray) -> np.ndarray:
    """Quantised logarithm of a count; 0 for none."""
    return np.where(n > 0, np.rint(COUNT_STEPS * np.log2(np.maximum(n, 1))) + 1, 0).astype(np.uint16)


def mass(code: np.ndarray) -> np.ndarray:
    """Discounted count that a code stands for."""
    return np.where(code > 0, 2.0 ** ((code.astype(np.float64) - 1) / COUNT_STEPS) - DISCOUNT, 0.0)


def prob_code(p: np.ndarray) -> np.ndarray:
    """Quantised logarithm of a probability."""
    with np.errstate(divide="ignore"):
        return np.minimum(65535, np.rint(-PROB_STEPS * np.log10(p))).astype(np.uint16)


def _bigrams(row: dict):
    """Of a batch: its tokens, each one's document, the distinct bigrams as context * n_words + word, rising, the order
    that sorts all bigrams, and where in it each distinct one begins."""
    t = _unpack(row["tokens"])[0].astype(np.int64)
    size = np.array(row["size"], np.int64)
    before = np.append(row["end"], t[:-1])
    pair = before * row["n_words"] + t
    order = np.argsort(pair, kind="stable")
    begins = np.flatnonzero(np.diff(pair[order], prepend=-1))
    return t, np.repeat(np.arange(len(size)), size), pair[order[begins]], order, begins


def _shards_of(ctx: np.ndarray, word: np.ndarray, home: np.ndarray, split: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each bigram: its context's, or one for each word after it if the context has many counts."""
    return np.where(split[ctx], (home[ctx] + home[word] + 1) % shards, home[ctx])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are words after lower-casing A-Z, then one end. Counts come from texts whose crc32 of the id modulo 5 isn't
    1. ``base_score`` is the additive unigram score. ``score`` is the log10 probability under a bigram model: counts of
    (context, word) with a Dirichlet prior of PRIOR counts on a discounted unigram model with quantised counts, whose
    unseen words share DISCOUNT times the seen words. The probabilities are proper: over seen words and one unseen word
    they sum to one in every context.

    Texts are tokenized once, in batches. Three exchanges of compressed blobs follow: words to ranges of hashes and
    their counts back, distinct bigrams to shards by context, and quantised probabilities back to their batch, which
    sums them over its tokens. A shard's bigrams of training texts make a trie, which all its bigrams are looked up in.
    A batch asks once for a bigram, however often it has it, and a context with many counts is split by word, so that
    no word and no pair of words is hot. No table grows on the driver or in a broadcast, and a shard holds a bounded
    number of bigrams. Words are known by 64-bit hashes. Null is the empty text, whose only token is the end; a null id
    is text ''; a very long text is a batch of its own. Repeated rows count and are scored as they come; without
    training texts base_score follows its formula and score is 0; an empty table gives an empty table; other columns
    are ignored.
    """
    made = materialize(tokenize(docs, id_col, text_col))
    words, tokens = made.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_shards = 1 << max(3, int(words // SHARD_WORDS).bit_length())
    gram_shards = 1 << max(3, int(tokens // SHARD_GRAMS).bit_length())
    counted = materialize(count_words(made, word_shards))
    sums = np.zeros((word_shards, 4))
    for shard, blob in counted.where("batch is null").select("shard", "blob").toLocalIterator():
        sums[shard] = np.concatenate(_unpack(blob))
    n_all, v_all = int(sums[:, 0].sum()), int(sums[:, 1].sum())
    first = np.concatenate([[0], np.cumsum(sums[:, 2])]).astype(np.int64)
    unseen = DISCOUNT * v_all / max(1, n_all)
    scale = (1 - unseen) / max(1e-300, float(sums[:, 3].sum()))
    heavy = max(1, n_all // (4 * gram_shards))
    norm = np.log10(n_all + 0.5 * (v_all + 1)) if n_all + v_all else np.log10(0.5)

    def prior(code: np.ndarray) -> np.ndarray:
        return np.where(code > 0, mass(code) * scale, unseen)

    def grams(left, right):
        row = left.to_pylist()[0]
        width, blobs = row["n_words"], []
        n, ident = np.zeros(width, np.int64), np.zeros(width, np.int64)
        at = 0
        for shard, blob in sorted(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist())):
            count, place = _unpack(blob)
            k = len(count)
            n[at:at + k], ident[at:at + k] = count, np.cumsum(place, dtype=np.int64) + first[shard]
            at += k
        size, held = np.array(row["size"], np.int64), np.array(row["held"], bool)
        t, doc, pair, order, begins = _bigrams(row)
        known = np.bincount(doc, n[t] > 0, len(size)).astype(np.int64)
        base = np.bincount(doc, np.log10(n[t] + 0.5), len(size)) - size * norm
        home = ((ident.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % gram_shards
        split = n > heavy
        blobs.append((int(row["batch"] % gram_shards), 0, _pack(known, base, _least(home), split)))
        train = np.add.reduceat((~held)[doc[order]].astype(np.int64), begins)
        ctx, word = pair // width, pair % width
        shard = _shards_of(ctx, word, home, split, gram_shards)
        by = np.argsort(shard, kind="stable")
        ctx, word, train, shard = ctx[by], word[by], train[by], shard[by]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        code = count_code(n)
        for i, j in zip(cuts, np.append(cuts[1:], len(shard))):
            c, x = ctx[i:j], ident[word[i:j]]
            start = np.flatnonzero(np.diff(c, prepend=-1))
            step = np.diff(x, prepend=0)
            step[start] = x[start]
            blobs.append((int(shard[i]), 1, _pack(
                _least(_gaps(ident[c[start]])), _least(n[c[start]]), _least(np.diff(np.append(start, j - i))), _least(step),
                _least(code[word[i:j]]), _least(train[i:j]))))
        cols = list(zip(*blobs))
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "batch": pa.array([row["batch"]] * len(blobs), pa.int64()), "kind": pa.array(cols[1], pa.int32()), "blob": pa.array(cols[2], pa.binary())})

    def look_up(table):
        kind, shard = table.column("kind").to_pylist(), table.column("shard")[0].as_py()
        rows = list(zip(table.column("batch").to_pylist(), table.column("blob").to_pylist()))
        out = [(b, 0, x) for k, (b, x) in zip(kind, rows) if not k]
        asked = [(b, _unpack(x)) for k, (b, x) in zip(kind, rows) if k]
        if asked:
            parts = []
            for _, (own, n, succ, step, code, train) in asked:
                start = np.append(0, np.cumsum(succ, dtype=np.int64))
                step = np.cumsum(step, dtype=np.int64)
                back = np.append(0, step)[start[:-1]]
                parts.append((np.repeat(np.cumsum(own, dtype=np.int64), succ), step - np.repeat(back, succ), np.repeat(n, succ), code, train))
            ctx, word, total, code, train = (np.concatenate(c) for c in zip(*parts))
            del parts
            order = np.lexsort((word, ctx))
            ctx, word = ctx[order], word[order]
            seen = np.flatnonzero(train[order] > 0)
            c, w = ctx[seen], word[seen]
            begins = np.flatnonzero(np.append(True, (np.diff(c) != 0) | (np.diff(w) != 0))) if len(seen) else seen
            count = np.add.reduceat(train[order[seen]].astype(np.int64), begins) if len(seen) else seen
            one = order[seen[begins]]
            trie = Trie(c[begins], w[begins], prob_code((count + PRIOR * prior(code[one])) / (total[one] + PRIOR)))
            got, found = trie.find(ctx, word)
            told = np.zeros(len(ctx), np.uint16)
            if n_all:
                told[order] = np.where(found, got, prob_code(PRIOR * prior(code[order]) / (total[order] + PRIOR)))
            at = 0
            for b, (*_, own_code, _) in asked:
                out.append((b, 1, _pack(told[at:at + len(own_code)])))
                at += len(own_code)
        return pa.table({"shard": pa.array([shard] * len(out), pa.int32()), "batch": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def gather(left, right):
        row = left.to_pylist()[0]
        rows = sorted(zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("blob").to_pylist()), key=lambda r: r[:2])
        known, base, home, split = _unpack(rows[0][2])
        _, doc, pair, order, begins = _bigrams(row)
        by = np.argsort(_shards_of(pair // row["n_words"], pair % row["n_words"], home.astype(np.int64), split, gram_shards), kind="stable")
        log = np.empty(len(pair))
        log[by] = np.concatenate([_unpack(x)[0] for _, _, x in rows[1:]]) / -PROB_STEPS
        size = np.array(row["size"], np.int64)
        score = np.bincount(doc[order], np.repeat(log, np.diff(np.append(begins, len(order)))), len(size))
        cols = (row["ids"], row["held"], size, known, np.full(len(score), n_all), base, score)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    texts = made.select("batch", "ids", "held", "size", "tokens", "n_words", "end").groupBy("batch")
    asked = texts.cogroup(counted.where("batch is not null").groupBy("batch")).applyInArrow(grams, "shard int, batch long, kind int, blob binary")
    found = asked.groupBy("shard").applyInArrow(look_up, "shard int, batch long, kind int, blob binary")
    return texts.cogroup(found.groupBy("batch")).applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
