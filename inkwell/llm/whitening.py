"""Embedding whitening: partitions' singular value decompositions merged level by level, with nothing cut off."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tidy

#: Entries become integers: floor of this many times the entry, plus the shift.
SCALE, SHIFT = 1024, 100_000
#: Largest integer entry; larger ones count as this, since their squares don't fit any result.
LARGEST = 1 << 40
#: Rows decomposed at once in a task.
ROWS = 4096
#: Decompositions merged in one task of a level.
FAN = 32

_PARTS = "part long, n long, sums array<decimal(38,0)>, s array<double>, v binary"
_MOMENTS = "part long, n long, mean array<double>, m2 array<double>"


def finite(vec: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    ok = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(vec.isNotNull() & ok, F.lit(False))


def as_integers(vec: Column) -> Column:
    """floor(SCALE * c) + SHIFT of every entry, as long."""
    return F.transform(vec, lambda c: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE))).cast("long") + SHIFT)


@dataclass
class Spread:
    """A decomposition of centred rows: their number, exact sums, and all singular values and right vectors."""

    n: int
    sums: list[int]
    s: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Spread:
        """Of integer rows. Twelve bits of rows times forty of entries stay exact, so centring loses nothing."""
        total = x.sum(0)
        _, s, v = np.linalg.svd((len(x) * x - total) / len(x), full_matrices=False)
        return cls(len(x), total.tolist(), s, v)

    def merged(self, other: Spread) -> Spread:
        """Of the rows of both: their scaled vectors and one row for the distance of the means, decomposed again.

        The stacked matrix has the same product with itself as all centred rows. Every direction stays, so the order of
        merges changes no more than rounding.
        """
        n, m = self.n, other.n
        apart = np.array([float(m * a - n * b) for a, b in zip(self.sums, other.sums)]) / np.sqrt(float(n) * m * (n + m))
        _, s, v = np.linalg.svd(np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, apart]), full_matrices=False)
        return Spread(n + m, [a + b for a, b in zip(self.sums, other.sums)], s, v)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [_decimal(x) for x in self.sums], "s": self.s.tolist(), "v": self.v.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Spread:
        return cls(row["n"], [int(x) for x in row["sums"]], np.array(row["s"]), np.frombuffer(row["v"]).reshape(len(row["s"]), -1))


@dataclass
class Moments:
    """Number, mean and centred products of rows."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def merged(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.m2 + other.m2 + np.outer(apart, apart) * (self.n * (other.n / n)))

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tolist(), "m2": self.m2.ravel().tolist()}

    @classmethod
    def read(cls, row: dict) -> Moments:
        return cls(row["n"], np.array(row["mean"]), np.array(row["m2"]).reshape(len(row["mean"]), -1))


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<decimal(38,0)>": pa.list_(pa.decimal128(38, 0))}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.rsplit(" ", 1) for c in schema.split(", "))])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def reduced(rows: DataFrame, kind, schema: str, prepare, dims: int):
    """One ``kind`` over all rows, or None without rows.

    Each task folds its rows in parts of ROWS; then levels of FAN results to a task, each level a small written table,
    until one is left. No task and no driver holds more than FAN of them.
    """
    out = _arrow(schema)

    def run(batches):
        held = None
        for b in slices(batches, ROWS):
            if b.num_rows:
                new = kind.of(prepare(matrix(b.column(0), dims)))
                held = new if held is None else held.merged(new)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], schema=out)

    def merge(key, table):
        held = None
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            new = kind.read(r)
            held = new if held is None else held.merged(new)
        return pa.Table.from_pylist([held.row(key[0].as_py())], schema=out)

    parts = materialize(rows.mapInArrow(tidy(run), schema))
    while (left := parts.limit(2).collect()) and len(left) > 1:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / FAN).alias("level")).applyInArrow(merge, schema))
    return kind.read(left[0].asDict()) if left else None


@dataclass
class Whitener:
    """What whitens a row: number of rows, exact sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, all_rows: Spread, most: int) -> Whitener:
        """The first ``most`` components. A direction without variance has eigenvalue 0; each sign makes the largest entry positive."""
        e = all_rows.s**2 / all_rows.n
        e[all_rows.s <= all_rows.s.max(initial=0) * max(len(all_rows.sums), 1) * np.finfo(float).eps * 4] = 0
        v = all_rows.v[:most]
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if v.size else v
        trace = e.sum()
        return cls(all_rows.n, all_rows.sums, v, e[:most], e[:most] / trace if trace else np.zeros(len(v)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where that holds it, else in Python's integers."""
        if max(map(abs, self.sums), default=0) < 1 << 61 and self.n * int(np.abs(x).max(initial=0)) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of the squares of n * x - S of each row, exact."""
        t = self.centred(x)
        if t.dtype != object and int(np.abs(t).max(initial=0)) ** 2 * max(t.shape[1], 1) < 1 << 62:
            return pa.array((t * t).sum(1)).cast(pa.decimal128(38, 0))
        t = t.astype(object)
        return pa.array([_decimal(int(v)) for v in (t * t).sum(1)], pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components over the root of their eigenvalues; NaN where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(x).astype(float) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)
        out[:, self.eigenvalues == 0] = np.nan
        return out


def fit(vectors: DataFrame, dims: int, most: int) -> Whitener | None:
    """A whitener of all rows of (x array<long>) with ``dims`` entries each; None without rows."""
    found = reduced(vectors.select("x"), Spread, _PARTS, lambda x: x, dims)
    return None if found is None else Whitener.of(found, most)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "x", most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of integer vectors, a row for each
    vector and each of the first ``most`` components.

    All rows without a null vector or entry are fitted and returned; repeated rows count and stay; a null id stays null.
    Fewer rows or entries than ``most`` give so many components. Vectors have one length: those of another length than the most frequent (ties: the longest) are left out, as are
    empty ones. Directions without variance have ``whitened`` null and ``explained`` 0 and don't count in
    ``identity_error``, which is null if none is left. An empty table gives an empty table; other columns are ignored.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")).where("x IS NOT NULL AND forall(x, e -> e IS NOT NULL) AND size(x) > 0")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    size = src.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = size["d"]
    src = src.where(F.size("x") == dims)
    model = fit(src, dims, most)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # most vectors of dims numbers
    live = model.eigenvalues > 0
    error = None
    if live.any():
        cover = reduced(src.select("x"), Moments, _MOMENTS, lambda x: shared.value.whitened(x)[:, live], dims)
        error = float(np.abs(cover.m2 / cover.n - np.eye(live.sum())).max())

    def run(batches):
        m = shared.value
        k = len(m.components)
        for b in slices(batches, ROWS):
            x = matrix(b.column(1), dims)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            white = m.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), m.n)), m.deviation(x).take(at),
                pa.array(white, mask=np.isnan(white)), pa.array(np.tile(m.explained, len(x))), pa.array([error] * len(at), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(tidy(run), schema)


def whiten_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``whiten`` of the integers made of an embedding table. Null vectors and those with null or non-finite entries go."""
    kept = rows.where(finite(F.col(vec_col)))
    return whiten(kept.select(F.col(id_col).alias("vec_id"), as_integers(F.col(vec_col)).alias("x")))
