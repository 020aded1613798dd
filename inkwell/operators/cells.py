"""A stored inverted-file index: rows by cell, residuals as product codes, exact distances for the best."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows at most that centres and codes are fitted on: those with the smallest hash of the id. Every row is indexed.
SAMPLE = 20_000
#: Codes of a piece: one byte.
CODES = 256
#: Queries looked up in one pass over the cells.
BLOCK = 2_048
#: Queries whose distances to a batch are reckoned at once.
STEP = 128


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """At most k centres of the rows of a bounded sample; a centre without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = squared(x, centres)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        empty = np.flatnonzero(n == 0)
        centres = total / np.maximum(n, 1)[:, None]
        centres[empty] = x[far[:len(empty)]]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


@dataclass
class Codebook:
    """Cell centres (cells, d) and, for each piece of a vector, centres of residuals."""

    centres: np.ndarray
    pieces: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, pieces: int) -> Codebook:
        centres = lloyd(x, cells)
        rest = x - centres[squared(x, centres).argmin(1)]
        return cls(centres, [lloyd(part, CODES, 8) for part in np.array_split(rest, pieces, axis=1)])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        cell = squared(x, self.centres).argmin(1)
        rest = np.array_split(x - self.centres[cell], len(self.pieces), axis=1)
        return cell, np.stack([squared(r, c).argmin(1) for r, c in zip(rest, self.pieces)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each piece the distance of each query's residual in a cell to each code."""
        rest = np.array_split(queries - self.centres[cell], len(self.pieces), axis=1)
        return [squared(r, c) for r, c in zip(rest, self.pieces)]

    def nearest_cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(squared(queries, self.centres), axis=1, kind="stable")[:, :probes]

    def dump(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "pieces": [p.tolist() for p in self.pieces]})

    @classmethod
    def parse(cls, s: str) -> Codebook:
        x = json.loads(s)
        return cls(np.array(x["centres"]), [np.array(p) for p in x["pieces"]])


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def write_cells(corpus: DataFrame, path: str, cells: int = 64, pieces: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Store an index of all rows under ``path``: folders by cell with ids, codes and vectors, and the codebook.

    Vectors have one length; null vectors are left out. Rows go to files by ranges of (cell, id), so a large cell is
    many files and none is gathered in one task.
    """
    spark = corpus.sparkSession
    src = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("v IS NOT NULL")
    sample = src.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    if not len(sample):
        raise ValueError("no vectors")
    dims = len(sample[0])
    book = Codebook.fit(_rows(sample, dims), cells, pieces)
    shared = spark.sparkContext.broadcast(book)  # cells and codes, whatever the rows

    def run(batches):
        for b in batches:
            cell, codes = shared.value.place(_rows(b.column(1), dims))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), packed], ["id", "v", "cell", "code"])

    placed = src.mapInArrow(run, "id long, v array<float>, cell int, code binary")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(book.dump(), dims)], "book string, dims int").write.mode("overwrite").parquet(f"{path}/book")


def probed(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The stored rows of some cells; other folders aren't read."""
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(*cells))


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 16, refine: int = 10) -> DataFrame:
    """(query_id, id, distance, rank): near rows of each query (query_id, query_vec) from the cells nearest to it.

    Of the probed cells only ids and codes are read first. Each task adds up table entries and keeps the best
    ``refine`` times k of a query; the best of all get exact distances from their stored vectors. The queries are a
    stated set, BLOCK of them to a pass. No query gives no row.
    """
    stored = spark.read.parquet(f"{path}/book").first()
    book, dims = Codebook.parse(stored["book"]), stored["dims"]
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("q")).where("q IS NOT NULL").orderBy("query_id").toArrow()
    schema, out = "query_id long, id long, distance double, rank int", None
    for start in range(0, asked.num_rows, BLOCK):
        part = asked.slice(start, BLOCK)
        ids, q = part["query_id"].to_numpy(), _rows(part["q"].combine_chunks(), dims)
        near = book.nearest_cells(q, probes)
        found = _one_pass(spark, path, book, ids, q, near, k, k * refine)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _one_pass(spark: SparkSession, path: str, book: Codebook, ids: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, most: int) -> DataFrame:
    shared = spark.sparkContext.broadcast((book, ids, q, {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}))
    cells = sorted(shared.value[3])

    def run(batches):
        book, ids, q, by_cell = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(row), -1)
            for c in np.unique(cell).tolist():
                here = np.flatnonzero(cell == c)
                for s in range(0, len(by_cell[c]), STEP):
                    asking = by_cell[c][s:s + STEP]
                    d = np.zeros((len(asking), len(here)))
                    for m, table in enumerate(book.tables(q[asking], c)):
                        d += table[:, codes[here, m]]
                    for i, mine in zip(asking.tolist(), d):
                        best = np.argpartition(mine, most - 1)[:most] if len(mine) > most else np.arange(len(mine))
                        new = (mine[best], row[here[best]], np.full(len(best), c, np.int32))
                        if i in held:
                            new = tuple(map(np.concatenate, zip(held[i], new)))
                        if len(new[0]) > 2 * most:
                            cut = np.argpartition(new[0], most - 1)[:most]
                            new = tuple(x[cut] for x in new)
                        held[i] = new
        for i, (d, row, c) in held.items():
            best = np.lexsort((row, d))[:most]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[i])), pa.array(row[best]), pa.array(c[best]), pa.array(d[best])], ["query_id", "id", "cell", "about"])

    rows = probed(spark, path, cells)
    rough = rows.select("cell", "id", "code").mapInArrow(run, "query_id long, id long, cell int, about double")
    by = Window.partitionBy("query_id").orderBy("about", "id")
    best = rough.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).select("query_id", "id", "cell")
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q)], "query_id long, q array<double>")
    exact = F.reduce(F.zip_with("v", "q", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    near = best.join(rows.select("cell", "id", "v"), ["cell", "id"]).join(F.broadcast(asked), "query_id").select("query_id", "id", exact.alias("distance"))  # at most BLOCK queries
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
