"""Approximate neighbours by hierarchical small-world graphs, one for each block of rows."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one graph.
ROWS = 4_096
#: Links of a row to its nearest, on each layer, and rows that a search keeps.
LINKS, WIDTH = 16, 64
#: One row in so many is also on the next layer.
THIN = 16


def _links(x: np.ndarray, rows: np.ndarray, links: int) -> np.ndarray:
    """(rows, links) places in ``rows`` of each one's nearest others and, for half of them, of random ones that make the
    graph easy to cross; -1 where there are fewer."""
    v = x[rows]
    square = (v * v).sum(1)
    near, out = min(links, len(rows) - 1), np.full((len(rows), links + links // 2), -1, np.int32)
    for i in range(0, len(rows), 512):
        d = square[None] - 2 * v[i:i + 512] @ v.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if near > 0:
            out[i:i + 512, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
    out[:, links:] = np.random.default_rng(len(rows)).integers(0, len(rows), (len(rows), links // 2))
    return out


class Graph:
    """Layers of a block, the thinnest first: the rows on each and their links."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.x, self.layers, rows = vectors, [], np.arange(len(vectors))
        while len(rows):
            self.layers.insert(0, (rows, _links(vectors, rows, links)))
            rows = rows[THIN // 2::THIN] if len(rows) > THIN else rows[:0]

    def search(self, q: np.ndarray, k: int, width: int = WIDTH) -> list[tuple[float, int]]:
        """(squared distance, row) of k near rows: from layer to layer the best rows found so far are followed."""
        width, found = max(k, width), []
        for rows, links in self.layers:
            starts = np.searchsorted(rows, [r for _, r in found[:4]]).tolist() or [0]  # a layer's rows are on all below it
            seen, best, ahead = set(starts), [], []
            for s in starts:
                d = float(((self.x[rows[s]] - q) ** 2).sum())
                heapq.heappush(best, (-d, s)), heapq.heappush(ahead, (d, s))
            while ahead:
                d, s = heapq.heappop(ahead)
                if len(best) >= width and d > -best[0][0]:
                    break
                new = [n for n in dict.fromkeys(links[s].tolist()) if n >= 0 and n not in seen]
                seen.update(new)
                for d, n in zip(((self.x[rows[new]] - q) ** 2).sum(1).tolist(), new):
                    if len(best) < width or d < -best[0][0]:
                        heapq.heappush(best, (-d, n)), heapq.heappush(ahead, (d, n))
                        if len(best) > width:
                            heapq.heappop(best)
            found = sorted((-d, int(rows[s])) for d, s in best)
        return found[:k]


def build(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(block, ids, vectors, dim, layers): the graph of each block of at most about ``rows`` rows, for writing as a table.

    Rows are dealt to blocks by a hash of their id, so blocks are alike and none is large, whatever the data.
    """
    blocks = max(1, -(-corpus.count() * 5 // (rows * 4)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = np.stack([np.asarray(v.values, np.float32) for v in t["v"]])
        g = Graph(x)
        layers = [{"rows": r.astype(np.int32), "links": n.ravel()} for r, n in g.layers]
        kind = pa.list_(pa.struct([("rows", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))]))
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([x.ravel()], pa.list_(pa.float32())),
                         "dim": pa.array([x.shape[1]], pa.int32()), "layers": pa.array([layers], kind)})

    src = corpus.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return src.groupBy("block").applyInArrow(run, "block int, ids array<long>, vectors array<float>, dim int, layers array<struct<rows:array<int>,links:array<int>>>")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, block: int = 1_024) -> DataFrame:
    """(query_id, id, distance, rank): k near rows by squared L2 of each query, in the graphs of all blocks.

    The queries are a stated set, ``block`` of them at a time; each task gives k rows of a query for each graph that it
    has. Ties go to the smaller id.
    """
    asked = [(r[0], [float(x) for x in r[1]]) for r in queries.select("query_id", "query_vec").collect()]
    out = None
    for i in range(0, len(asked), block):
        shared = index.sparkSession.sparkContext.broadcast(asked[i:i + block])

        def run(batches, shared=shared):
            for b in batches:
                for ids, vectors, dim, layers in zip(*(b.column(c) for c in range(4))):
                    ids, g = np.asarray(ids.values), Graph.__new__(Graph)
                    g.x = np.asarray(vectors.values, np.float64).reshape(-1, dim.as_py())
                    g.layers = [(np.asarray(x["rows"].values), np.asarray(x["links"].values).reshape(len(x["rows"]), -1)) for x in layers]
                    rows = [(q, int(ids[r]), d) for q, v in shared.value for d, r in g.search(np.array(v), k, width)]
                    cols = list(zip(*rows)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

        found = index.select("ids", "vectors", "dim", "layers").mapInArrow(run, "query_id long, id long, distance double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return index.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int") if out is None else out
