"""Clustering, medoids, hierarchies, embedding training and dimension reduction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .vectors import dot, normalized, squared_l2

#: Rows that one agglomerative run or one node of a division may hold.
MAX_GROUP = 2_000
#: Texts that a task trains word vectors on.
ROWS_PER_TASK = 100_000


def with_vector(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(col, lambda x: x.cast("double"))))


def fit_kmeans(df: DataFrame, k: int, col: str = "embedding", seed: int = 0) -> KMeansModel:
    """K-means; no more clusters than rows."""
    return KMeans(k=max(1, min(k, df.count())), seed=seed, featuresCol="features").fit(with_vector(df, col))


def predict(model: KMeansModel, df: DataFrame, col: str = "embedding") -> DataFrame:
    """Rows with their cluster."""
    return model.transform(with_vector(df, col)).drop("features").withColumnRenamed("prediction", "cluster")


def update_centers(centers: list[list[float]], weights: list[float], batch: DataFrame, col: str = "embedding", decay: float = 1.0, reassign: float = 0.0, seed: int = 0) -> tuple[list[list[float]], list[float]]:
    """One mini-batch step: decayed means of the old centres and the batch's rows. Only sums by cluster come back.

    Centres whose weight is less than ``reassign`` of the largest are set anew to rows of the batch, those with the
    smallest seeded hash, with the least weight of the others.
    """
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    cell = F.array_min(F.transform(listed, lambda c, i: F.struct(squared_l2(F.col(col), c).alias("d"), i.alias("i"))))["i"]
    sums = batch.select(cell.alias("c"), F.col(col).alias("v")).select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()
    new, w = [list(c) for c in centers], [x * decay for x in weights]
    seen = {r["c"]: r["n"] for r in sums}
    for r in sums:
        c, d = r["c"], r["d"]
        new[c][d] = (centers[c][d] * w[c] + r["s"]) / (w[c] + r["n"])
    w = [x + seen.get(i, 0) for i, x in enumerate(w)]
    poor = [i for i, x in enumerate(w) if x < reassign * max(w)]
    if poor:
        rows = batch.select(F.transform(col, lambda x: x.cast("double")).alias("v")).distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(len(poor)).collect()
        rest = min(x for i, x in enumerate(w) if i not in poor)
        for i, r in zip(poor, rows):
            new[i], w[i] = list(r["v"]), rest
    return new, w


def members(df: DataFrame, cluster: str = "label", id_col: str = "vec_id", width: int = 1_000) -> DataFrame:
    """(cluster, page, ids) in order, in pages by ranges of ids, so that a cluster can have any size."""
    return df.groupBy(cluster, F.floor(F.col(id_col) / width).alias("page")).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def medoids(pairs: DataFrame) -> DataFrame:
    """(block, center): the member with the largest sum of similarities, the smallest of equals. ``pairs`` is mirrored."""
    sums = pairs.groupBy("block", "i").agg(F.sum("sim").alias("s"))
    return sums.groupBy("block").agg(F.max_by("i", F.struct(F.round("s", 9), -F.col("i"))).alias("center"))


def cosine_medoids(df: DataFrame, cluster: str = "label", id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(cluster, center): the member with the largest sum of cosines to all members, the smallest of equals.

    That sum is the member's product with the sum of all unit vectors, so no pair is made.
    """
    unit = df.select(cluster, F.col(id_col).alias("id"), normalized(F.col(col)).alias("u"))
    total = unit.groupBy(cluster).agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"))
    near = unit.join(total, cluster).select(cluster, "id", F.round(dot(F.col("u"), F.col("total")), 6).alias("s"))
    return near.groupBy(cluster).agg(F.min(F.struct((-F.col("s")).alias("s"), "id")).alias("m")).select(cluster, F.col("m.id").alias("center"))


def nearest_to_mean(df: DataFrame, cluster: str = "label", id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(cluster, center): the member with the smallest sum of squared distances, by the cluster's mean in two passes.

    The sum over members of the squared distance is, but for a constant, the count times the squared distance to the mean.
    """
    mean = df.select(cluster, F.posexplode(col).alias("d", "x")).groupBy(cluster, "d").agg(F.avg("x").alias("m"))
    mean = mean.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    near = df.join(mean, cluster).select(cluster, id_col, squared_l2(F.col(col), F.col("mean")).alias("d"))
    return near.groupBy(cluster).agg(F.min_by(id_col, F.struct(F.round("d", 9), id_col)).alias("center"))


def agglomerative(df: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", linkage: str = "average", group: str | None = None) -> DataFrame:
    """(group, id, cluster): merges the two nearest clusters until k are left, in groups of at most MAX_GROUP rows; larger
    groups go by ``single_linkage``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_GROUP:
            raise ValueError(f"a group has more than {MAX_GROUP} rows: single_linkage takes any number")
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
        np.fill_diagonal(d, np.inf)
        own, size = np.arange(len(x)), np.ones(len(x))
        for _ in range(len(x) - max(1, min(k, len(x)))):
            i, j = np.unravel_index(d.argmin(), d.shape)
            i, j = min(i, j), max(i, j)
            new = {"average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j])}[linkage]
            d[i], d[:, i], d[i, i] = new, new, np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            own[own == j] = i
        _, label = np.unique(own, return_inverse=True)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "cluster": label.astype("int32")})

    src = df.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(col).alias("v"))
    return src.groupBy("grp").applyInPandas(run, "grp long, id long, cluster int")


def single_linkage(df: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", group: str = "label", rounds: int = 60) -> DataFrame:
    """(group, id, cluster): clusters of each group, of any size, by single linkage and cosine distance.

    The k - 1 longest edges of the group's minimum spanning tree are cut (ties: those with larger ids); clusters are
    numbered by their smallest id. Equal vectors are together; zero vectors have no direction and get no cluster.
    """
    found, tree = similar.spanning_edges(df, group, id_col, col, rounds)
    longest = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("d"), F.desc("i"), F.desc("j")))
    cut = tree.withColumn("r", longest).where(F.col("r") < max(1, k)).select("grp", "i", "j", F.lit(True).alias("gone"))
    kept = similar.matched(tree, cut, {"grp": "grp", "i": "i", "j": "j"}, "left").where("gone IS NULL").drop("gone")
    nodes = found.where(F.exists("v", lambda x: x != 0)).select("grp", F.col("rep").alias("id"))
    own = similar.components(nodes, kept)
    first = own.groupBy("grp", "c").agg(F.min("id").alias("least"))
    number = first.select("grp", "c", (F.row_number().over(Window.partitionBy("grp").orderBy("least")) - 1).alias("cluster"))  # k rows a group
    placed = similar.matched(own, number, {"grp": "grp", "c": "c"}).select("grp", F.col("id").alias("node"), "cluster")
    return similar.matched(similar.membership(df, found, group, id_col, col), placed, {"grp": "grp", "rep": "node"}).select("grp", "id", "cluster")


def layerwise_division(df: DataFrame, layers: int, k: int, id_col: str = "vec_id", col: str = "embedding", seed: int = 0) -> DataFrame:
    """(path, layer, id, center): rows divided k ways in each layer, every node with its member nearest to the mean.

    Rows of one layer's nodes are clustered together: centres of each node by sums over (node, cluster, dimension).
    """
    now = df.select(F.col(id_col).alias("id"), F.col(col).alias("v"), F.lit("0").alias("path"))
    out = None
    for layer in range(layers):
        centers = nearest_to_mean(now, "path", "id", "v")
        level = now.join(centers, "path").select("path", F.lit(layer).alias("layer"), "id", "center")
        out = level if out is None else out.unionByName(level)
        if layer == layers - 1:
            break
        starts = now.select("path", "id", "v", F.xxhash64("id", F.lit(seed)).alias("h"))
        seeds = starts.groupBy("path").agg(*[F.min_by("v", F.xxhash64("h", F.lit(i))).alias(f"c{i}") for i in range(k)]).select("path", F.array(*[f"c{i}" for i in range(k)]).alias("cs"))
        for _ in range(5):
            cell = F.array_min(F.transform("cs", lambda c, i: F.struct(squared_l2(F.col("v"), c).alias("d"), i.alias("i"))))["i"]
            placed = now.join(seeds, "path").withColumn("cell", cell)
            means = placed.select("path", "cell", F.posexplode("v").alias("d", "x")).groupBy("path", "cell", "d").agg(F.avg("x").alias("m"))
            means = means.groupBy("path", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
            seeds = means.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "c"))), lambda s: s["c"]).alias("cs")).checkpoint()
        cell = F.array_min(F.transform("cs", lambda c, i: F.struct(squared_l2(F.col("v"), c).alias("d"), i.alias("i"))))["i"]
        now = now.join(seeds, "path").select("id", "v", F.concat_ws(".", "path", cell.cast("string")).alias("path")).checkpoint()
    return out


def train_words(docs: DataFrame, tokens: str = "tokens", size: int = 150, least: int = 100, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(word, vec) by skip-gram, in one task for every ROWS_PER_TASK texts unless told otherwise."""
    partitions = partitions or max(1, docs.count() // ROWS_PER_TASK)
    model = Word2Vec(vectorSize=size, minCount=least, seed=seed, numPartitions=partitions, inputCol=tokens, outputCol="v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def approximate_nearest(corpus: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", col: str = "embedding", width: float = 2.0, tables: int = 8, seed: int = 0) -> DataFrame:
    """(id, distance): nearest by locality-sensitive hashing."""
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(with_vector(corpus, col))
    found = model.approxNearestNeighbors(with_vector(corpus, col), Vectors.dense(vector), k, distCol="distance")
    return found.select(F.col(id_col).alias("id"), (F.col("distance") * F.col("distance")).alias("distance"))


def svd(df: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, list[float]]:
    """((id, vec), share of each singular value): the left singular vectors, not centred. Kept as it is if short enough.

    Tasks sum the products of dimensions; their square table, of a size set by the dimension, comes to the driver. The
    largest number of each right vector is positive.
    """
    size = df.select(F.max(F.size(col))).first()[0] or 0
    if size <= k:
        return df.select(F.col(id_col).alias("id"), F.col(col).alias("vec")), []

    def matrix(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)

    def products(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = matrix(b.column(0))
            total += x.T @ x
        i, j = np.indices((size, size))
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], ["i", "j", "x"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.transform(col, lambda x: x.cast("double")).alias("v"))
    sums = src.select("v").mapInArrow(products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((size, size))
    for r in sums:
        gram[r["i"], r["j"]] = r["x"]
    values, right = np.linalg.eigh(gram)
    values, right = np.maximum(values[::-1][:k], 0), right[:, ::-1][:, :k]
    right = right * np.sign(right[np.abs(right).argmax(0), np.arange(k)])
    scale = np.divide(right, np.sqrt(values), out=np.zeros_like(right), where=values > 1e-12 * max(1e-300, values.max()))

    def left(batches):
        for b in batches:
            u = matrix(b.column(1)) @ scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), k).cast(pa.list_(pa.float64()))], ["id", "vec"])

    return src.mapInArrow(left, "id long, vec array<double>"), [float(x / values.sum()) for x in values]


def pca(df: DataFrame, k: int, col: str = "embedding") -> tuple[DataFrame, list[float]]:
    """(Rows with their principal components, cumulative shares of variance)."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(with_vector(df, col))
    shares = model.explainedVariance.toArray().cumsum().tolist()
    return model.transform(with_vector(df, col)).withColumn("pc", vector_to_array("pc")).drop("features"), shares
