"""Similarity joins of vectors: classes of equal vectors, blocks of near ones, and matrix products of blocks that can hold a link."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .cells import lloyd, squared
from .vectors import ladder

#: Vectors of a block, about; two blocks are compared in one task.
BLOCK = 1_000
#: Blocks of a tile, about; those of two tiles are in a task's memory.
TILE = 16
#: Vectors at most that pivots are chosen from, those with the smallest hash of the id. Pivots decide what is near in a
#: block and so how many pairs of blocks are passed over, never a result.
SAMPLE = 20_000
PIVOTS = 256


def matched(a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` where the named columns of both are equal; nulls are equal too."""
    key = {v: f"__{v}" for v in on.values()}
    same = [F.col(k).eqNullSafe(F.col(key[v])) for k, v in on.items()]
    return a.join(b.select(*[F.col(c).alias(key.get(c, c)) for c in b.columns]), reduce(Column.__and__, same), how).drop(*key.values())


def classes(vectors: DataFrame, group: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(grp, rep, size, v): equal vectors of a group as one row under their smallest id. Counted in tasks before the
    shuffle. Null vectors and null ids have none."""
    rows = vectors.select(F.col(group).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    return rows.groupBy("grp", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size")).select("grp", "rep", "size", "v")


def membership(vectors: DataFrame, found: DataFrame, group: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(grp, rep, id): every row with the class that it is in."""
    rows = vectors.select(F.col(group).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL")
    return matched(rows.where("v IS NOT NULL"), found.select("grp", "v", "rep"), {"grp": "grp", "v": "v"}).select("grp", "rep", "id")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blocks(found: DataFrame) -> DataFrame:
    """(grp, block, ids, v binary, centre, angle): a group's unit vectors in blocks of about BLOCK near ones, with the
    largest angle between the block's centre and a vector.

    A vector's cell is its nearest pivot; a large cell is dealt into blocks by a hash of the id, so no cell is gathered.
    Zero vectors have no direction and are in no block.
    """
    spark = found.sparkSession
    some = found.where(F.exists("v", lambda x: x != 0))
    n = some.count()
    sample = some.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    if not n:
        return spark.createDataFrame([], f"grp {dict(found.dtypes)['grp']}, block string, ids array<bigint>, v binary, centre array<double>, angle double")
    pivots = spark.sparkContext.broadcast(lloyd(_unit(_vectors(sample)), max(1, min(PIVOTS, n // BLOCK)), 6))

    def place(batches):
        for b in batches:
            cell = squared(_unit(_vectors(b.column(2))), pivots.value).argmin(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["grp", "rep", "v", "cell"])

    kind = dict(found.dtypes)["grp"]
    placed = stored(some.select("grp", "rep", "v").mapInArrow(place, f"grp {kind}, rep long, v array<double>, cell int"), "placed")
    many = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    dealt = matched(placed, many, {"grp": "grp", "cell": "cell"}).select("grp", "rep", "v", F.concat_ws("-", "cell", F.pmod(F.xxhash64("rep"), "many")).alias("block"))

    def pack(key, table):
        ids = table["rep"].combine_chunks()
        u = _unit(_vectors(table["v"].combine_chunks()))
        order = np.argsort(ids.to_numpy(), kind="stable")
        u, mean = u[order], u.sum(0)
        centre = mean / np.linalg.norm(mean) if mean.any() else u[0]
        angle = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        return pa.table({"grp": pa.array([key[0].as_py()], table["grp"].type), "block": [key[1].as_py()], "ids": pa.array([ids.to_numpy()[order].tolist()], pa.list_(pa.int64())),
                         "v": pa.array([u.tobytes()], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "angle": [angle]})

    return dealt.groupBy("grp", "block").applyInArrow(pack, f"grp {kind}, block string, ids array<bigint>, v binary, centre array<double>, angle double")


def block_pairs(packed: DataFrame, least: float = -1.0) -> DataFrame:
    """Pairs of a group's blocks, each with itself too, that can hold a cosine of ``least``: the angle between the
    centres is at most both blocks' angles and that of ``least``. Only the heads of the blocks are paired."""
    head = packed.select("grp", "block", "centre", "angle")
    a, b = (head.select(F.col("grp").alias(f"g{s}"), F.col("block").alias(s), F.col("centre").alias(f"c{s}"), F.col("angle").alias(f"r{s}")) for s in "ab")
    dot = F.reduce(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    near = a.join(b, F.col("ga").eqNullSafe(F.col("gb")) & (F.col("a") <= F.col("b"))).where(apart <= F.col("ra") + F.col("rb") + math.acos(max(-1.0, least)) + 1e-7)
    return near.select(F.col("ga").alias("grp"), "a", "b")


def compared(packed: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over pairs of blocks as (grp, a, b, ids_a, v_a, ids_b, v_b). A group's blocks are dealt into tiles of about
    TILE; two tiles meet in a task, so a block is sent once for each tile that it is paired with, not for each block."""
    many = packed.groupBy("grp").agg(F.ceil(F.count("*") / TILE).alias("many"))
    tile = matched(packed.select("grp", "block"), many, {"grp": "grp"}).select("grp", "block", F.pmod(F.xxhash64("block"), "many").alias("tile"))
    side = lambda s: tile.select("grp", F.col("block").alias("n"), F.col("tile").alias(f"t{s}"))
    both = matched(matched(pairs, side("a"), {"grp": "grp", "a": "n"}), side("b"), {"grp": "grp", "b": "n"})
    both = both.select("grp", F.least("ta", "tb").alias("p"), F.greatest("ta", "tb").alias("q"), "a", "b")
    ends = both.select("grp", "p", "q").distinct().withColumn("t", F.explode(F.array_distinct(F.array("p", "q"))))
    held = matched(packed.select("grp", "block", "ids", "v"), tile, {"grp": "grp", "block": "block"})
    rows = matched(ends, held, {"grp": "grp", "t": "tile"}).select("grp", "p", "q", "block", "ids", "v").unionByName(both, allowMissingColumns=True)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, wanted = {}, []
        for batch in batches:
            grp, block, ids, v, a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("grp", "block", "ids", "v", "a", "b"))
            for k, name in enumerate(block.to_pylist()):
                if name is None:
                    wanted.append([x.slice(k, 1) for x in (grp, a, b)])
                else:
                    blocks[name] = ids.slice(k, 1), v.slice(k, 1)
        for grp, a, b in wanted:
            yield from run(iter([pa.RecordBatch.from_arrays([grp, a, b, *blocks[a[0].as_py()], *blocks[b[0].as_py()]], ["grp", "a", "b", "ids_a", "v_a", "ids_b", "v_b"])]))

    return rows.groupBy("grp", "p", "q").applyInArrow(meet, schema)


def links(packed: DataFrame, least: float) -> DataFrame:
    """(grp, i, j, sim) for i < j: all pairs of a group whose cosine, to six places, is at least ``least``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                grp, a, b, ids_a, v_a, ids_b, v_b = (batch.column(c)[k] for c in range(7))
                ids_a, ids_b = ids_a.values.to_numpy(), ids_b.values.to_numpy()
                x, y = (np.frombuffer(v.as_py()).reshape(len(n), -1) for v, n in ((v_a, ids_a), (v_b, ids_b)))
                sim = np.round(x @ y.T, 6)
                i, j = np.nonzero(np.triu(sim >= least, 1) if a.as_py() == b.as_py() else sim >= least)
                p, q = ids_a[i], ids_b[j]
                yield pa.RecordBatch.from_arrays([pa.array([grp.as_py()] * len(i), batch.column(0).type), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sim[i, j])], ["grp", "i", "j", "sim"])

    return compared(packed, block_pairs(packed, least), run, f"grp {dict(packed.dtypes)['grp']}, i long, j long, sim double")


def similarity_join(vectors: DataFrame, least: float, group: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(classes, links): equal vectors of a group as classes (grp, rep, size, v), and all pairs of representatives with
    cosine ``least`` or more as (grp, i, j, sim). Exact: blocks are passed over only where angles rule a link out. An
    empty table gives empty tables."""
    found = stored(classes(vectors, group, id_col, vec_col), "classes")
    packed = stored(blocks(found), "blocks")
    return found, links(packed, least)


def adjusted_links(found: DataFrame, linked: DataFrame) -> DataFrame:
    """(grp, i, j, sim): links scaled in both rows so that a row's second-largest similarity meets the ladder, cut at 1,
    and averaged.

    The largest similarity of a row is its own, so the second is 1 in a class of several, else that of its best link:
    a row with any link has that among them, and no other entry of the row is needed.
    """
    both = linked.select("grp", "i", "sim").union(linked.select("grp", F.col("j"), "sim"))
    best = both.groupBy("grp", "i").agg(F.max("sim").alias("s"))
    many = found.where("size > 1").select("grp", "rep", F.lit(1.0).alias("copy"))
    rows = matched(best, many, {"grp": "grp", "i": "rep"}, "left").select("grp", "i", F.coalesce("copy", "s").alias("s"))
    rows = rows.select("grp", "i", F.when(F.col("s") == 0, 0.0).otherwise(F.try_divide(ladder(F.col("s")), F.col("s"))).alias("f"))
    side = lambda s: rows.select("grp", F.col("i").alias("n"), F.col("f").alias(f"f{s}"))
    out = matched(matched(linked, side("a"), {"grp": "grp", "i": "n"}), side("b"), {"grp": "grp", "j": "n"})
    scaled: list[Column] = [F.least(F.lit(1.0), F.col("sim") * F.col(f)) for f in ("fa", "fb")]
    return out.select("grp", "i", "j", ((scaled[0] + scaled[1]) / 2).alias("sim"))


def spanning_edges(vectors: DataFrame, group: str = "label", id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): a minimum spanning tree of each group's distinct directions by cosine distance, as (grp, i, j, d).

    Rounds of Boruvka: blocks are compared in pairs, each task keeps the nearest row of another component for each
    component of a block, one row for each component is left, and components joined by these edges become one by
    pointer jumping. Each round at least halves the components; the pairs grow with the square of a group, their rows
    with the group.
    """
    found = stored(classes(vectors, group, id_col, vec_col), "classes")
    packed = stored(blocks(found), "blocks")
    kind = dict(found.dtypes)["grp"]
    pairs = stored(block_pairs(packed), "pairs")
    own = stored(packed.select("grp", "block", F.posexplode("ids").alias("pos", "id")).withColumn("c", F.col("id")), "components")
    tree = None
    for _ in range(rounds):
        sides = own.groupBy("grp", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("cs"))  # a block's rows
        tagged = matched(packed, sides, {"grp": "grp", "block": "block"}).select("grp", "block", F.arrays_zip("ids", "cs").alias("ids"), "v")
        best = stored(compared(tagged, pairs, _foreign, f"grp {kind}, c long, d double, lo long, hi long, other long").groupBy("grp", "c").agg(F.min(F.struct("d", "lo", "hi", "other")).alias("e")).select("grp", "c", "e.*"), "nearest")
        if best.isEmpty():
            break
        edges = best.select("grp", F.col("lo").alias("i"), F.col("hi").alias("j"), "d").distinct()
        tree = edges if tree is None else tree.unionByName(edges)
        own = stored(_joined(own, best), "components")
    else:
        raise RuntimeError("components did not settle")
    if tree is None:
        tree = found.sparkSession.createDataFrame([], f"grp {kind}, i long, j long, d double")
    return found, tree


def _foreign(batches):
    """For each component of two blocks its nearest row of another component; of equal ones that with the smallest ids."""
    for batch in batches:
        for k in range(batch.num_rows):
            grp, a, b, rows_a, v_a, rows_b, v_b = (batch.column(c)[k] for c in range(7))
            (ids_a, c_a), (ids_b, c_b) = ((r.values.field("ids").to_numpy(), r.values.field("cs").to_numpy()) for r in (rows_a, rows_b))
            x, y = (np.frombuffer(v.as_py()).reshape(n, -1) for v, n in ((v_a, len(ids_a)), (v_b, len(ids_b))))
            d = np.round(1 - x @ y.T, 9)
            d[c_a[:, None] == c_b[None, :]] = np.inf
            out = []
            for ids, cs, far_ids, far_cs, m in ((ids_a, c_a, ids_b, c_b, d), (ids_b, c_b, ids_a, c_a, d.T)):
                least = m.min(1)
                ends = np.where(m == least[:, None], np.minimum(ids[:, None], far_ids) * 1.0, np.inf)
                tie = (m == least[:, None]) & (ends == ends.min(1)[:, None])
                at = np.where(tie, np.maximum(ids[:, None], far_ids) * 1.0, np.inf).argmin(1)
                lo, hi = np.minimum(ids, far_ids[at]), np.maximum(ids, far_ids[at])
                order = np.lexsort((hi, lo, least, cs))
                first = order[np.append(True, cs[order][1:] != cs[order][:-1])]
                out += [(cs[f], least[f], lo[f], hi[f], far_cs[at[f]]) for f in first if np.isfinite(least[f])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([grp.as_py()] * len(out), batch.column(0).type), *(pa.array([o[n] for o in out]) for n in range(5))], ["grp", "c", "d", "lo", "hi", "other"])


def _joined(own: DataFrame, best: DataFrame) -> DataFrame:
    """Components after joining along each one's best edge. Edges are in one strict order, so two components at most
    point at each other; the smaller of them is the root, and every other follows its pointer until all point at roots."""
    point = best.select("grp", "c", F.col("other").alias("up"))
    up = matched(point, point.select("grp", F.col("c").alias("k"), F.col("up").alias("again")), {"grp": "grp", "up": "k"}).select("grp", "c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up"))
    while True:
        up = stored(up, "pointers")
        over = up.select("grp", F.col("c").alias("k"), F.col("up").alias("next"))
        new = matched(up, over, {"grp": "grp", "up": "k"}).select("grp", "c", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        new = stored(new, "pointers")
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    roots = up.select("grp", F.col("c").alias("k"), F.col("up").alias("root"))
    rest = [x for x in own.columns if x != "c"]
    return matched(own, roots, {"grp": "grp", "c": "k"}, "left").select(*rest, F.coalesce("root", "c").alias("c"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(grp, id, c): nodes (grp, id) with a number of the component that edges (grp, i, j, d) join them to."""
    own = stored(nodes.withColumn("c", F.col("id")), "components")
    edges = stored(edges, "edges")
    for _ in range(rounds):
        side = lambda s: own.select("grp", "id", F.col("c").alias(f"c{s}"))
        both = matched(matched(edges, side("a"), {"grp": "grp", "i": "id"}), side("b"), {"grp": "grp", "j": "id"}).where("ca <> cb")
        turned = both.select("grp", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other")))).alias("x"), "d", "i", "j")
        best = stored(turned.groupBy("grp", "x.c").agg(F.min(F.struct("d", "i", "j", "x.other")).alias("e")).select("grp", "c", "e.other"), "nearest")
        if best.isEmpty():
            return own
        own = stored(_joined(own, best), "components")
    raise RuntimeError("components did not settle")
