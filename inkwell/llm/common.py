"""Shared helpers: tables in the shared scratch folder, row keys and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table

#: Word separators: space and the ASCII control white space.
SPACE = r"\x20\x09-\x0D"
#: Distinct edges at most whose components are found in one task.
SMALL_GRAPH = 100_000
#: Folders of materialized tables that are still there.
_MADE: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a fresh local folder;
    a cluster gets an error, since its machines share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="inkwell-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back; ``more`` are further rows of the same columns,
    written one after the other, so that only one job's shuffle files are there at a time.

    Cuts the lineage like a reliable checkpoint, in columnar form, so a lost executor only re-reads a file.
    The files go when the driver's JVM ends; the shuffle files of the job go when it ends.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{scratch_root(spark)}/inkwell/{name}"
    write_table(df, path)
    for part in more:
        write_table(part, path, "append")
    _MADE.add(name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that nothing reads any more. Other tables stay as they are."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            name = folder.rsplit("/", 1)[-1]
            if name in _MADE:
                _MADE.remove(name)
                target = spark._jvm.org.apache.hadoop.fs.Path(folder)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two long columns that tell its rows apart, and their names.

    Rows of a Parquet scan are named by a hash of their file and their place in it, so nothing is copied. Any other
    table is written once with a number in each row, since numbers given on the fly could change when a task runs
    again.
    """
    file, place = fresh(df, "row_file", "row_place")
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0].lower():
        return df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)), [file, place]
    return materialize(df.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(place))), [file, place]


def without_rows(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a keyed table whose key isn't in ``gone``, without the key.

    ``gone`` is written first, so that the planner knows its size: below its broadcast limit the rows stay where they
    are, else they are shuffled by their keys, of which none is hot.
    """
    return df.join(materialize(gone), key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns if c not in key])


def tidy(run):
    """A function over record batches that hands back memory at the end of its partition.

    Python workers are kept for later stages; what their allocators hold would count against the executor all along.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def slices(batches, rows: int = 512):
    """Record batches in parts of so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _union_find(batches):
    """Components of the edges (u, v) of one partition, which holds all of them."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(a), find(c)
            root[max(a, c)] = min(a, c)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    At most SMALL_GRAPH distinct edges, a counted bound of a few megabytes, are joined in one task instead, with the
    same result.

    ``edges`` has two long columns ``a`` and ``b``. Returns (node, root): each node of an edge with the smallest
    node reachable. Every round is two pre-aggregated minima and two joins; no neighbour list is ever gathered.
    An empty edge table gives an empty result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= SMALL_GRAPH:
        return now.coalesce(1).mapInArrow(tidy(_union_find), "node long, root long")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where("u <> v").distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
