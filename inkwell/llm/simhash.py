"""Near-duplicate detection: SimHash components by pigeonhole blocks; near copies by shingle prefixes and exact similarity."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, discard, materialize, slices, tidy

#: A block with more distinct fingerprints than this goes by shared midpoints instead of pairs.
PAIR_LIMIT = 48
#: A block of near copies with more members than this is paired by whole fingerprints.
FEW = 6
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16

#: BITS[v, j]: bit j (from the most significant) of byte v.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, n: int, seed: int = 42):
    """Unsigned XXH64 of each n-word shingle, in order, repeats included, in chunks.

    Words are runs of bytes outside space and \\t..\\r after lower-casing A-Z. A text with fewer words than ``n``
    is one shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return
    line, n = b" ".join(words), min(n, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - n + 1], end[n - 1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), CHUNK):
        spans = zip(start[i:i + CHUNK].tolist(), end[i:i + CHUNK].tolist())
        yield np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(start[i:i + CHUNK]))


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """64-bit SimHash; a bit is 1 if set in over half of the shingle hashes. No words: 0."""
    ones, total = np.zeros((8, 8), np.int64), 0
    place = 256 * np.arange(8)
    for h in shingle_hashes(text or b"", n):
        seen = np.bincount((h.astype(">u8").view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
        ones += seen.reshape(8, 256) @ BITS
        total += len(h)
    return int.from_bytes(np.packbits((2 * ones > total).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, n) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("t"))
    return src.mapInArrow(tidy(run), "doc_id long, fp long")


def near_links(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints within ``radius`` (at most 2) differing bits.

    The 64 bits are cut into ``blocks`` blocks. A pair within the radius agrees on all but ``radius`` blocks, so each
    fingerprint is keyed by every choice of ``blocks - radius`` blocks, and only pairs that share a key are compared.
    A key shared by more than PAIR_LIMIT fingerprints isn't paired: its members meet at midpoints (themselves and
    each one-bit change outside the key), since two fingerprints within two bits share a midpoint and two that share
    a midpoint are within two bits. There each links to the smallest only, so the links stay linear and the
    components exact.
    """
    if not 0 <= radius <= 2 or blocks <= radius:
        raise ValueError("radius is 0 to 2, and there are more blocks than that")
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edge[b + 1]) - (1 << edge[b]) for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fp = F.col("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(signed(m))) for m in masks])).alias("k", "v"))
    sized = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sized, ["k", "v"]))
    few, many = met.where(F.col("n") <= PAIR_LIMIT), met.where(F.col("n") > PAIR_LIMIT)
    left, right = few.select("k", "v", fp.alias("a")), few.select("k", "v", fp.alias("b"))
    pairs = left.join(right, ["k", "v"]).where("a < b").select("a", "b")
    flips = F.element_at(F.array(*[F.array(*[F.lit(0), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]]) for m in masks]), F.col("k") + 1)
    mids = many.select(fp, F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("mid"))
    stars = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = mids.join(stars, "mid").where("a <> fp").select("a", fp.alias("b"))
    return pairs.union(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_components(docs: DataFrame, n: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints within ``radius`` bits link; ``component_id`` is the smallest doc_id reachable, itself included.
    Null or wordless texts have fingerprint zero and link like any other. Rows with a null id keep their fingerprint
    and get the component of the other rows with it, if any. Repeated rows stay repeated; an empty table gives an
    empty table; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, n, id_col, text_col))
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(near_links(first.select("fp"), radius))
    joined = linked.join(first, linked.node == first.fp).select("node", "root", "first")
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    named = materialize(joined.join(lowest, "root").select(F.col("node").alias("fp"), "lowest"))
    owner = first.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return marked.join(owner, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of whole texts: five-word shingles, similarity 0.8, so two sign bits differ with this chance.
WORDS = 5
SIMILARITY = 0.8
DIFFER = float(np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi)
#: Bits of the wide fingerprint. Pairs that differ in at most SURE bits are alike, 5.5 standard deviations below the
#: mean at SIMILARITY; those in up to MAYBE, as much above it, are checked on their shingles.
WIDE = 2048
SURE, MAYBE = (int(WIDE * DIFFER + k * (WIDE * DIFFER * (1 - DIFFER)) ** 0.5) for k in (-5.5, 5.5))
#: Sets with fewer shingles than this are always checked on their shingles: few shingles fold to few fingerprints, and
#: different short texts can share one.
SMALL = 32
#: Documents from which frequent shingles are counted, and how many of these are known. They only decide which shingles
#: come last in a prefix; candidates are complete under any order.
SAMPLE = 20_000
FREQUENT = 1 << 16
#: One key in so many is taken in the first round; what it joins isn't compared again in the second.
FIRST = 8
#: Jobs, one after the other, in which sets and their keys are shuffled, each some of them.
TURNS = 6
#: Members of a larger key, and shingles of them, in one of the pieces that are compared with each other.
CROWD, CROWD_SHINGLES = 4096, 1 << 20

_H = np.array([[1.0]], np.float32)
while len(_H) < 64:
    _H = np.block([[_H, _H], [_H, -_H]])
_FLIP = np.where(np.random.default_rng(11).random((64, 64)) < 0.5, -1, 1).astype(np.float32)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), WIDE // 8) bytes: SimHash bits of sets of five-word shingles.

    The set is folded into 4096 signed sums by hash; the fingerprint is the signs of half of their Walsh-Hadamard
    transform, so a shingle is hashed once however many bits there are. Equal sets have equal fingerprints, but equal
    fingerprints don't mean equal sets; an empty set has all bits 0.
    """
    sums = np.zeros((len(sets), 4096), np.float32)
    for row, h in zip(sums, sets):
        at, sign = (h & np.uint64(4095)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
        row += np.bincount(at, sign, 4096)
    mixed = _H[:WIDE // 64] @ (sums.reshape(-1, 64, 64) * _FLIP) @ _H
    return np.packbits(mixed.reshape(len(sets), WIDE) > 0.5, axis=1)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, ascending, and their counts."""

    def sets(batches):
        for b in slices(batches, 256):
            found = [_shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    part = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, texts.count() // SAMPLE))) == 0).select("t")
    seen = part.mapInArrow(tidy(sets), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = (rows[c].to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n shingles, rare ones first, in an order that is the same for all sets.

    Two sets alike at 0.8 share at least ceil(0.8 n) shingles for either n, so the first shingle they share is in both
    prefixes.
    """
    known, counts = frequent
    n, times = len(shingles), np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        times = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, times))[: n - (4 * n + 4) // 5 + 1]]


MEMBER = ("node", "root", "size", "pos")


def _apart(x, y):
    """Hamming distance of two wide fingerprints."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def _may_meet(x, y):
    """Whether two members of a key, of different groups, can be alike if it is the first shingle they share: then they
    share what follows it at most, and need 4/9 of both sizes."""
    return (x["root"] != y["root"]) & (9 * F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= 4 * (x["size"] + y["size"]))


def _met(rows: DataFrame, more=None) -> DataFrame:
    """Pairs (a, b) of different groups under a key that may be alike and meet a further condition."""
    x, y = F.col("x"), F.col("y")
    close = (x["node"] < y["node"]) & _may_meet(x, y)
    right = rows.select(F.col("key").alias("k"), F.col("x").alias("y"))
    met = rows.join(right, (F.col("key") == F.col("k")) & (close if more is None else close & more(x, y)))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def _pairs(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs under keys of at most PAIR_LIMIT members.

    Under keys of more than FEW members, where most come from one large family, whole fingerprints are compared inside
    the join, so that it puts out near pairs only.
    """
    pairs = _met(met.where(F.col("n") <= FEW).where(F.col("n") <= PAIR_LIMIT).select("key", F.struct(*MEMBER).alias("x")))
    some = met.where((F.col("n") > FEW) & (F.col("n") <= PAIR_LIMIT)).join(nodes.select("node", "fp"), "node")
    some = some.select("key", F.struct(*MEMBER, "fp").alias("x"))
    return pairs.union(_met(some, lambda x, y: (F.least(x["size"], y["size"]) < SMALL) | (_apart(x["fp"], y["fp"]) <= MAYBE)))


def _crowds(met: DataFrame, groups: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b, ra, rb) between groups that share a key of more than PAIR_LIMIT members, checked.

    Only sets of like size can be alike, so a key's members are dealt into cells by size: a member goes to the cell of
    its own size, and as a guest to the next. A cell of many members is cut into pieces, and each two pieces are
    compared in a task of their own, which puts out no more links than it has members.
    """
    many = met.where(F.col("n") > PAIR_LIMIT).join(groups, "node").select("key", "node", "root", "size")
    cell = F.floor(F.log("size") / F.log(F.lit(1.26))).cast("int")  # sizes within 4/5 of each other are at most one apart
    many = many.select("*", F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("home")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("home")))).alias("c")).select("key", "node", "root", "size", "c.*")
    cells = many.groupBy("key", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("s"), F.max("home").alias("any"))
    last = F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("s") / CROWD_SHINGLES)).cast("int") - 1
    many = materialize(many.join(cells.where("lo < hi AND any").select("key", "cell", last.alias("last")), ["key", "cell"]))
    told = _told(nodes, many.select("node").distinct(), texts)
    keys = many.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("others"))
    held = nodes.join(keys, "node").join(told, "node").select("node", "fp", "hs", "others")
    piece = F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int")
    dealt = many.select("key", "cell", "node", "root", "size", "home", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    dealt = dealt.withColumn("p", F.least("piece", "other")).withColumn("q", F.greatest("piece", "other")).drop("other").join(held, "node")
    return dealt.groupBy("key", "cell", "p", "q").applyInArrow(_crowd, "a long, b long, ra long, rb long")


def _crowd(t: pa.Table) -> pa.Table:
    """Links between two pieces, or within one: as few as join the groups of all alike pairs.

    A pair that shares a smaller crowded key is left to that key. Fingerprints decide the clear cases and shingle sets
    the others; pairs that earlier links have joined aren't compared.
    """
    t = t.combine_chunks()
    piece, node, root, size, home = (t[c].to_numpy() for c in ("piece", "node", "root", "size", "home"))
    rows = len(node)

    def flat(name):
        x = t[name].combine_chunks()
        return x.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))

    fp = flat("fp")[0].reshape(rows, -1).view(np.uint64)
    shingles, at = flat("hs")
    shingles = shingles.view(np.uint64)
    others, ends = flat("others")
    smaller = others < t["key"][0].as_py()
    names, column = np.unique(others[smaller], return_inverse=True)
    shared = np.zeros((rows, len(names)), np.float32)
    shared[np.repeat(np.arange(rows), np.diff(ends))[smaller], column] = 1
    label = np.unique(root, return_inverse=True)[1]
    p, q = t["p"][0].as_py(), t["q"][0].as_py()
    xs, ys = np.flatnonzero(piece == p), np.flatnonzero(piece == q)

    def alike(me, ask):
        """Which of ``ask`` are alike to ``me`` by their sets."""
        own, n = shingles[at[me]:at[me + 1]], at[ask + 1] - at[ask]
        out = []
        for part in np.split(np.arange(len(ask)), np.flatnonzero(np.diff(np.cumsum(n) // CROWD_SHINGLES)) + 1):
            begins = np.append(0, np.cumsum(n[part])[:-1])
            asked = shingles[np.repeat(at[ask[part]] - begins, n[part]) + np.arange(n[part].sum())]
            both = np.add.reduceat(own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked, begins, dtype=np.int64)
            out.append(5 * both >= 4 * (len(own) + n[part] - both))
        return np.concatenate(out)

    links = []

    def join(me, found):
        for one, j in zip(*np.unique(label[found], return_index=True)):
            if one != label[me]:
                links.append((me, found[j]))
                label[label == one] = label[me]

    for i in range(0, len(xs), 32):
        x = xs[i:i + 32]
        may = (label[x][:, None] != label[ys]) & (home[x][:, None] | home[ys]) & (5 * np.minimum(size[x][:, None], size[ys]) >= 4 * np.maximum(size[x][:, None], size[ys]))
        if p == q:
            may &= x[:, None] < ys
        if len(names):
            may &= shared[x] @ shared[ys].T == 0
        a, b = np.nonzero(may)
        b = ys[b]
        apart, small = np.bitwise_count(fp[x[a]] ^ fp[b]).sum(1, dtype=np.int64), np.minimum(size[x[a]], size[b]) < SMALL
        sure = ~small & (apart <= SURE)
        doubt = ~sure & (small | (apart <= MAYBE))
        cuts = np.searchsorted(a, np.arange(len(x) + 1))
        for me, j, k in zip(x.tolist(), cuts, cuts[1:]):
            join(me, b[j:k][sure[j:k]])
            ask = b[j:k][doubt[j:k]]
            ask = ask[label[ask] != label[me]]
            if len(ask):
                join(me, ask[alike(me, ask)])
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in (node[a], node[b], root[a], root[b])], ["a", "b", "ra", "rb"])


def _told(nodes: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, hs): the shingle sets of the nodes wanted, from their documents' texts again."""
    ends = materialize(nodes.join(wanted, "node").select("node", F.col("doc").alias("doc_id")))  # of a size that the planner knows
    told = texts.join(ends.select("doc_id"), "doc_id").select("doc_id", "t").mapInArrow(tidy(_sets), "node long, hs array<long>")
    told = materialize(told.join(ends.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hs").alias("hs")))
    discard(ends)
    return told


def _tops(edges: DataFrame) -> DataFrame:
    """(root, top): what the roots joined by edges (a, b) become."""
    return materialize(connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")))


def _joined(tops: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups after their roots became others."""
    return materialize(groups.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _link(nodes: DataFrame, groups: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups (node, root) after the candidate pairs: sure ones link; those neither sure nor far apart that are still
    between two groups are checked on their shingle sets, as are all pairs with a small set. ``pairs`` has the roots of
    both ends."""
    flip = F.col("a") > F.col("b")
    pairs = pairs.select(*[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in ("ab", "ba")], *[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ra", "rb"), ("rb", "ra"))]).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias("f" + c), F.col("size").alias("s" + c))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(5 * F.least("sa", "sb") >= 4 * F.greatest("sa", "sb"))
    near = near.select("a", "b", "ra", "rb", _apart("fa", "fb").alias("apart"), (F.least("sa", "sb") < SMALL).alias("small"))
    near = materialize(near.where(F.col("small") | (F.col("apart") <= MAYBE)))

    sure = ~F.col("small") & (F.col("apart") <= SURE)
    tops = _tops(near.where(sure).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    groups = _joined(tops, groups)
    doubt = near.where(~sure)
    for c in ("ra", "rb"):
        doubt = doubt.join(tops.select(F.col("root").alias(c), F.col("top").alias("t" + c)), c, "left").withColumn(c, F.coalesce("t" + c, c))
    doubt = materialize(doubt.where("ra <> rb").select("a", "b", "ra", "rb"))
    discard(near, tops)
    if doubt.isEmpty():
        return groups
    told = _told(nodes, doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)
    both = doubt.join(told.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a").join(told.select(F.col("node").alias("b"), F.col("hs").alias("hb")), "b")
    tops = _tops(both.select("ra", "rb", "ha", "hb").mapInArrow(tidy(_similar), "a long, b long"))
    groups = _joined(tops, groups)
    discard(doubt, told, tops)
    return groups


def _shingle_set(text: bytes | None) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text or b"", WORDS)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _name(shingles: np.ndarray) -> int:
    """A signed long that stands for the whole set."""
    return xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), 7) - (1 << 63)


def _long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(batches):
    """(node, hs): the shingle sets of texts."""
    for b in slices(batches, 256):
        sets = [_shingle_set(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_name(h) for h in sets], pa.int64()), _long_lists(sets)], ["node", "hs"])


def _similar(batches):
    """Pairs whose five-word shingle sets are alike at SIMILARITY (4/5) or more."""
    for b in slices(batches, 128):
        keep = []
        for p, q in zip(b.column(2), b.column(3)):
            p, q = (x.values.to_numpy(zero_copy_only=False) for x in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(5 * both >= 4 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id): groups of documents whose five-word shingles are alike at 0.8 or more, linked transitively.

    ``group_id`` is the smallest doc_id of the group. Equal sets, known by a 64-bit hash of the whole set, are one node
    from the start. Each set is keyed by the shingles of its prefix, so that any two sets alike at 0.8 share a key: no
    pair is missed by chance. Pairs that share a key and can be alike by their sizes and the key's place are held to the
    Hamming distance of wide SimHash fingerprints, with cut-offs of 5.5 standard deviations, and to their shingle sets
    where that leaves doubt or a set is small. What one round joins is no pair in the next. Members of a key of more
    than PAIR_LIMIT come last and are compared in tasks, which put out only links that join groups: the time of such a
    family of texts grows with the square of its members that nothing has joined yet, spread over tasks of CROWD by
    CROWD members.

    Null and wordless texts are copies of each other; shorter texts are one shingle. The id is a long, or a struct of
    columns without nulls, ordered by its fields. Rows with a null id are left out; rows that share an id are one
    document. An empty table gives an empty table; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    kind = kind.simpleString() if isinstance(kind, T.StructType) else "long"

    def sketch(batches):
        frequent = known.value
        for b in slices(batches, 256):
            sets = [_shingle_set(t) for t in b.column(1).to_pylist()]
            longs = wide_fingerprints(sets).view(">i8").astype(np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(longs) + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.ravel()))
            node, size = pa.array([_name(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32())
            keys = _long_lists([_prefix(h, frequent) for h in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), node, size, fp, keys], ["doc_id", "node", "size", "fp", "keys"])

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("doc_id"), F.encode(text_col, "UTF-8").alias("t"))
    known = docs.sparkSession.sparkContext.broadcast(_frequent(src))
    marked = materialize(src.mapInArrow(tidy(sketch), f"doc_id {kind}, node long, size int, fp array<long>, keys array<long>"))
    known.destroy()
    turn = lambda df, c: [df.where(F.pmod(c, F.lit(TURNS)) == k) for k in range(TURNS)]
    nodes = materialize(*[df.groupBy("node").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("size", "fp", "keys")]) for df in turn(marked, "node")])
    marked, sketches = materialize(marked.select("doc_id", "node")), marked  # fingerprints and keys are with the nodes now
    discard(sketches)
    groups = nodes.select("node", F.col("node").alias("root"))
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    met = materialize(*[df.join(df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key") for df in turn(keyed, "key")])
    few, first = met.where(F.col("n") <= PAIR_LIMIT), F.pmod("key", F.lit(FIRST)) == 0
    for some in (few.where(first), few.where(~first)):
        groups = _link(nodes, groups, _pairs(some.join(groups, "node"), nodes), src)
    if not met.where(F.col("n") > PAIR_LIMIT).isEmpty():
        tops = _tops(_crowds(met, groups, nodes, src).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        groups = _joined(tops, groups)
        discard(tops)
    discard(met)
    named = nodes.select("node", "doc").join(groups, "node")
    lowest = named.groupBy("root").agg(F.min("doc").alias("group_id"))
    return marked.select("doc_id", "node").join(named.join(lowest, "root").select("node", "group_id"), "node").select("doc_id", "group_id")
