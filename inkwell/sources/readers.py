"""Readers of article folders, record files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

NAME = "element_at(split(_metadata.file_path, '/'), -1)"


def files(spark: SparkSession, folder: str, suffix: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, text): whole text files; an unreadable or empty one is no row, so a join from the names gives '' for it."""
    reader = spark.read.option("pathGlobFilter", suffix).option("ignoreCorruptFiles", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.expr(NAME).alias("name"), F.coalesce("value", F.lit("")).alias("text"))


def listing(spark: SparkSession, folder: str, suffix: str = "*", recursive: bool = False, least: int = 0) -> DataFrame:
    """(path, name, size) of files larger than ``least`` bytes, contents unread; empty files are no rows."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", suffix)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(folder).where(F.col("length") > least).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """(pmcid, nxml): articles in files of one or more parts, {id}.nxml or {id}_{part}.nxml; parts end in ' \\n' and stop
    at the first gap."""
    rows = files(spark, folder, "*.nxml", True).select(
        F.regexp_extract("name", r"^(.*?)(?:_(\d+))?\.nxml$", 1).alias("pmcid"), F.expr(r"try_cast(regexp_extract(name, '^(.*?)(?:_([0-9]+))?[.]nxml$', 2) AS INT)").alias("part"), "text")
    parts = rows.groupBy("pmcid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("part", F.lit(0)).alias("part"), F.col("part").isNotNull().alias("many"), "text"))).alias("p"))
    whole = F.filter("p", lambda x, i: x["part"] == i)
    told = F.transform(whole, lambda x: F.when(x["many"], F.concat(x["text"], F.lit(" \n"))).otherwise(x["text"]))
    return parts.select("pmcid", F.array_join(told, "").alias("nxml"))


def with_articles(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Papers with their article, null where it is missing."""
    return papers.join(found, "pmcid", "left")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): lines without white space at their ends."""
    return spark.read.text(path).select(T.trim(F.col("value")).alias("line"))


def joined_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): a file's lines trimmed and joined by spaces."""
    rows = files(spark, path)
    return rows.select("name", F.array_join(F.transform(F.split("text", "\n"), T.trim), " ").alias("text"))


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tokens): the words of each line."""
    return spark.read.text(path).select(T.words(F.col("value")).alias("tokens"))


def licences(spark: SparkSession, path: str) -> DataFrame:
    """Licence list with a header and no quoting; ids lose their PMC prefix; of equal ids the last line counts."""
    rows = spark.read.csv(path, header=True, quote="", schema=schemas.LICENCE).withColumn("pmcid", F.substr("pmcid", F.lit(4)))
    rows = rows.withColumn("__n", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in ("pmcid", "__n")]
    return rows.groupBy("pmcid").agg(F.max_by(F.struct(*rest), "__n").alias("r")).select("r.file_loc", "r.journal_name", "pmcid", "r.modified_date", "r.pmid", "r.license_type")


def journals(spark: SparkSession, path: str) -> DataFrame:
    """(journal): the Title column of a list split by semicolons."""
    return spark.read.csv(path, sep=";", header=True).select(F.col("Title").alias("journal"))


def paper_info(spark: SparkSession, path: str) -> DataFrame:
    """Records of eight fields between white space; underscores stand for spaces. Other lines are left out."""
    w = T.words(F.col("value"))
    rows = spark.read.text(path).where(F.size(w) == 8)
    return rows.select(w[0].alias("pmcid"), T.spaced(w[1]).alias("title"), T.spaced(w[2]).alias("journal"), T.spaced(w[3]).alias("journal_abbrev"),
                       w[4].alias("year"), w[5].alias("month"), w[6].alias("day"), w[7].try_cast("int").alias("cited_times"))


def bad_paper_info(spark: SparkSession, path: str) -> DataFrame:
    """Lines that don't have eight fields."""
    return spark.read.text(path).where(F.size(T.words(F.col("value"))) != 8)


def group_arrays(spark: SparkSession, path: str, schema: str = schemas.GROUP) -> DataFrame:
    """Rows of files with one JSON array of groups in each line."""
    parsed = spark.read.text(path).select(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>").alias("a"))
    return parsed.select(F.inline("a"))


def document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def sentence_text(spark: SparkSession, path: str, by: str = "pe") -> DataFrame:
    """(sentence): a whole file split at '. ' (pe), or cleaned lines (lb)."""
    if by == "pe":
        return files(spark, path).select(F.explode(F.split("text", "[.] ")).alias("sentence"))
    return spark.read.text(path).select(T.clean_segment(F.col("value")).alias("sentence"))


def line_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, title, abstract): two lines of a file are one record; a last odd line has no abstract."""
    rows = files(spark, path).select("name", F.split("text", "\n").alias("l"))
    steps = F.sequence(F.lit(0), F.greatest(F.size("l") - 1, F.lit(0)), F.lit(2))
    rows = rows.select("name", F.posexplode(F.transform(steps, lambda i: F.struct(F.get("l", i).alias("title"), F.get("l", i + 1).alias("abstract")))).alias("idx", "r"))
    return rows.select("name", "idx", "r.title", "r.abstract").where("title <> '' OR abstract IS NOT NULL")


def shards(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, size: int = 1_000_000) -> DataFrame:
    """Rows of a store cut by ranges of ids; only folders of the asked range are read."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("shard") >= start // size) & (F.col("seg_id") >= start))
    return rows if end is None else rows.where((F.col("shard") <= end // size) & (F.col("seg_id") < end))


def point(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def decoded(binaries: DataFrame, decoder=None) -> DataFrame:
    """(path, text): binary files by a plugged-in decoder, bytes in, text out; without one they are read as UTF-8."""
    if decoder is None:
        return binaries.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    run = F.udf(lambda b: decoder(bytes(b)), "string")
    return binaries.select("path", run("content").alias("text"))
