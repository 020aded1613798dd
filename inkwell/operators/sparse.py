"""Randomised singular value decomposition of a sparse matrix in long form: products by joins, orthogonal bases by a tree of QR."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import stored

#: Triangles merged in one task of a level.
FAN = 32


def start(names: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(k, v): a row of ``width`` normal numbers for each name, drawn from the name's hash, so a lost task draws the same."""

    def run(batches):
        for b in batches:
            seeds = b.column(1).to_pylist()
            v = np.stack([np.random.default_rng([seed, s % 2**32, s // 2**32 % 2**32]).normal(size=width) for s in seeds]) if seeds else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([b.column(0), _listed(v)], ["k", "v"])

    return names.select("k", F.xxhash64("k").alias("h")).mapInArrow(run, f"k {dict(names.dtypes)['k']}, v array<double>")


def _listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def product(entries: DataFrame, tall: DataFrame, out: str, by: str) -> DataFrame:
    """(k, v): the matrix (``out``, ``by``, x) times a tall one. Whole rows are summed in tasks before and after the
    shuffle."""
    rows = entries.select(F.col(out).alias("to"), F.col(by).alias("k"), F.col("x").cast("double").alias("x")).join(tall, "k")
    return rows.groupBy("to").agg(vector_to_array(Summarizer.sum(array_to_vector(F.transform("v", lambda y: y * F.col("x"))))).alias("v")).select(F.col("to").alias("k"), "v")


def triangle(tall: DataFrame, width: int) -> np.ndarray:
    """R of a tall matrix's QR: each task folds its rows into one triangle, then FAN triangles to a task in each level.
    Numbers of ``width`` squared come to the driver, once."""
    schema, kinds = "part long, r binary", pa.schema([("part", pa.int64()), ("r", pa.binary())])
    square = lambda r: np.frombuffer(r).reshape(-1, width)

    def run(batches):
        held = np.zeros((0, width))
        for b in batches:
            held = np.linalg.qr(np.vstack([held, _rows(b.column(0), width)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "r": held.tobytes()}], schema=kinds)

    def merge(key, table):
        held = np.vstack([square(r["r"]) for r in sorted(table.to_pylist(), key=lambda r: r["part"])])
        return pa.Table.from_pylist([{"part": key[0].as_py(), "r": np.linalg.qr(held, mode="r").tobytes()}], schema=kinds)

    parts = stored(tall.select("v").mapInArrow(run, schema), "triangles")
    while len(left := parts.limit(2).collect()) > 1:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN).alias("level")).applyInArrow(merge, schema), "triangles")
    r = square(left[0]["r"]) if left else np.zeros((0, width))
    return np.vstack([r, np.zeros((width - len(r), width))])


def times(tall: DataFrame, m: np.ndarray) -> DataFrame:
    """A tall matrix times a small one, row by row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _listed(_rows(b.column(1), len(m)) @ m)], ["k", "v"])

    return tall.select("k", "v").mapInArrow(run, f"k {dict(tall.dtypes)['k']}, v array<double>")


def orthogonal(tall: DataFrame, width: int) -> DataFrame:
    """An orthonormal basis of a tall matrix's columns, written. The inverse triangle is applied twice, which brings
    back what rounding loses; directions that the columns don't have stay zero."""
    for _ in range(2):
        tall = stored(times(tall, np.linalg.pinv(triangle(tall, width), rcond=1e-10)), "basis")
    return tall


def randomized_svd(entries: DataFrame, k: int, extra: int = 16, power: int = 6, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((k, v), singular values): the first ``k`` left singular vectors of a sparse matrix (i, j, x), a row for each i that
    has an entry, and their singular values.

    Random directions are multiplied by the matrix and its transpose in turn, ``power`` times, orthogonalised at each
    step; the small problem left has k + extra numbers on a side. Nothing has the size of the vocabulary squared, and
    the tall matrices are tables. The largest number of each vector is positive. Entries of one place are added up;
    null and zero ones count nothing. An empty matrix has no rows and no values.
    """
    entries = stored(entries.where("x <> 0").select("i", "j", "x"), "entries")
    width = k + extra
    tall = start(entries.select(F.col("j").alias("k")).distinct(), width, seed)
    basis = orthogonal(stored(product(entries, tall, "i", "j"), "range"), width)
    for _ in range(power):
        back = orthogonal(stored(product(entries, basis, "j", "i"), "range"), width)
        basis = orthogonal(stored(product(entries, back, "i", "j"), "range"), width)
    r = triangle(stored(product(entries, basis, "j", "i"), "range"), width)
    u, s, _ = np.linalg.svd(r.T)
    left = stored(times(basis, u[:, :k]), "left")
    signs = left.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.max_by(F.signum("x"), F.abs("x")).alias("sign")).collect()  # k numbers
    turn = np.diag([next((row["sign"] for row in signs if row["d"] == d), 1.0) for d in range(k)])
    return times(left, turn), [float(x) for x in s[:k]] if signs else []


def _tiled_product(tiles: DataFrame, edges: list[int], tall: np.ndarray) -> np.ndarray:
    """A symmetric matrix, given as tiles (p, q, i, j, x) of its upper half, times a tall one. A task adds up its tiles'
    rows by block, and tasks' sums meet by block."""
    width = tall.shape[1]
    known = tiles.sparkSession.sparkContext.broadcast(tall)

    def run(batches):
        t, sums = known.value, {}
        for b in batches:
            for p, q, i, j, x in zip(*(b.column(c).to_pylist() for c in ("p", "q", "i", "j", "x"))):
                i, j, x = np.frombuffer(i, np.int32), np.frombuffer(j, np.int32), np.frombuffer(x)
                rows, at = np.unique(i, return_inverse=True)
                part = np.zeros((len(rows), edges[q + 1] - edges[q]))
                part[at, j] = x
                for of in (p, q):
                    sums.setdefault(of, np.zeros((edges[of + 1] - edges[of], width)))
                sums[p][rows] += part @ t[edges[q]:edges[q + 1]]
                if p == q:
                    part[np.arange(len(rows)), rows] = 0
                sums[q] += part.T @ t[edges[p] + rows]
        for of, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(v) for b in batches for v in b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])

    out = np.zeros((edges[-1], width))
    for r in tiles.mapInArrow(run, "block int, v binary").groupBy("block").applyInArrow(add, "block int, v binary").toLocalIterator():
        out[edges[r["block"]]:edges[r["block"] + 1]] = np.frombuffer(r["v"]).reshape(-1, width)
    known.destroy()
    return out


def symmetric_svd(tiles: DataFrame, names: pa.Array, edges: list[int], k: int, extra: int = 16, power: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(places of the names that have an entry, their first ``k`` singular vectors, singular values) of a symmetric matrix
    in tiles, by the steps of ``randomized_svd`` from the same directions.

    The matrix is read in place, neither joined nor shuffled. The tall matrices, k + extra numbers for each name, are
    held on the driver.
    """
    spark, width = tiles.sparkSession, k + extra
    square = lambda t: np.vstack([r := np.linalg.qr(t, mode="r"), np.zeros((width - len(r), width))])

    def orthogonal_of(t):
        for _ in range(2):
            t = t @ np.linalg.pinv(square(t), rcond=1e-10)
        return t

    drawn = start(spark.createDataFrame(pa.table({"k": names})), width, seed).orderBy("k").toArrow()  # names are in order
    basis = _tiled_product(tiles, edges, _rows(drawn["v"].combine_chunks(), width))
    met = np.flatnonzero(_tiled_product(tiles, edges, np.ones((len(names), 1)))[:, 0] > 0)
    if not len(met):
        return met, np.zeros((0, k)), []
    basis = orthogonal_of(basis)
    for _ in range(2 * power):
        basis = orthogonal_of(_tiled_product(tiles, edges, basis))
    u, s, _ = np.linalg.svd(square(_tiled_product(tiles, edges, basis)).T)
    left = (basis @ u[:, :k])[met]
    sign = np.sign(left[np.abs(left).argmax(0), np.arange(k)])
    return met, left * np.where(sign == 0, 1.0, sign), [float(x) for x in s[:k]]
