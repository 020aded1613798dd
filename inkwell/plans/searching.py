"""Queries on search over sentence groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blockindex, search, sections
from ..session import scratch
from . import common as C
from .common import register, table
from .texts import group_sql

QUERIES: dict = {}

#: The query of the search examples; section and journal are played by lang and source.
QUERY = "the thing that eran"

_GROUPS = f"""docs AS (SELECT doc_id, text, lang AS section, source AS journal, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, CAST(n_chars % 50 AS INTEGER) AS cited_times FROM documents),
    groups AS (SELECT doc_id * 1000000 + sent_id * 10 + num_group AS id, * FROM ({group_sql(1, "doc_id, section, journal, year, cited_times", "docs")} UNION ALL {group_sql(2, "doc_id, section, journal, year, cited_times", "docs")}))"""
_INDEX = """post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: w <> '')) AS term FROM groups) GROUP BY 1, 2)"""
_ASKED = "asked AS (SELECT unnest(['the', 'thing', 'that', 'eran']) AS term)"
_BM25 = """df AS (SELECT term, count(*) AS df FROM post JOIN asked USING (term) GROUP BY 1),
    score AS (SELECT id, sum(ln(1 + ((SELECT count(*) FROM groups) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2)) AS score FROM post JOIN df USING (term) GROUP BY 1)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "text", F.col("lang").alias("section"), F.col("source").alias("journal"), (1990 + F.col("doc_id") % 30).cast("string").alias("year"), (F.col("n_chars") % 50).cast("int").alias("cited_times"))
    keep = ("doc_id", "section", "journal", "year", "cited_times")
    rows = sections.groups_of_sizes(docs, (1, 2), keep=keep)
    return rows.withColumn("id", F.col("doc_id") * 1000000 + F.col("sent_id") * 10 + F.col("num_group"))


@register(QUERIES, f"WITH {_GROUPS}, {_INDEX}, {_ASKED}, {_BM25} SELECT id, round(score + 1, 6) AS score FROM groups JOIN score USING (id) WHERE number_of_words >= 5 ORDER BY score DESC, cited_times DESC, id LIMIT 120")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_groups(spark, d), QUERY).select("id", F.round("score", 6).alias("score"))


@register(QUERIES, f"WITH {_GROUPS}, {_INDEX}, {_ASKED} SELECT id, 2.0::DOUBLE AS score FROM groups WHERE number_of_words >= 5 AND id IN (SELECT id FROM post JOIN asked USING (term)) ORDER BY cited_times DESC, id LIMIT 120")
def const_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_groups(spark, d), QUERY, scoring="const").select("id", "score")


@register(QUERIES, f"""WITH {_GROUPS}, {_INDEX}, {_ASKED}, {_BM25} SELECT id, round(score + 4, 6) AS score, year, cited_times FROM groups JOIN score USING (id)
    WHERE number_of_words >= 5 AND section = 'en' AND journal = 'src3' AND year::INT >= 1995 AND cited_times >= 10 AND num_group <= 2 ORDER BY score DESC, cited_times DESC, id LIMIT 120""")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(_groups(spark, d), QUERY, section="en", journal="src3", min_year=1995, min_cited=10, max_group=2)
    return found.select("id", F.round("score", 6).alias("score"), "year", "cited_times")


@register(QUERIES, f"""WITH {_GROUPS}, {_INDEX}, voc AS (SELECT DISTINCT term FROM post), q AS (SELECT unnest(['thing', 'eraning', 'of']) AS asked)
    SELECT asked, term FROM q, voc WHERE levenshtein(asked, term) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END""")
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    index = search.postings(_groups(spark, d), "id", "content")
    asked = spark.createDataFrame([("thing",), ("eraning",), ("of",)], "term string")
    return search.expand_terms(asked, index)


@register(QUERIES, f"SELECT item_id, CAST(n AS INTEGER) AS words, [1, 1, 2, 2, 3, 3, 5][least(n, 7)] AS num_group FROM (SELECT item_id, len({C.words('text')}) AS n FROM benchmark)")
def num_group_for_query(spark: SparkSession, d: str) -> DataFrame:
    """The largest sentence group for each benchmark item taken as a query."""
    rows = table(spark, d, "benchmark").select("item_id", F.size(T.words(F.col("text"))).alias("words"))
    return rows.select("item_id", "words", search.groups_for_query(F.col("words")).alias("num_group"))


@register(QUERIES, f"""WITH {_GROUPS}, ones AS (SELECT id, doc_id, sent_id, content FROM groups WHERE num_group = 1)
    SELECT o.id, coalesce(p.content, '') AS prev, coalesce(n.content, '') AS next FROM ones o
    LEFT JOIN ones p ON p.doc_id = o.doc_id AND p.sent_id = o.sent_id - 1 LEFT JOIN ones n ON n.doc_id = o.doc_id AND n.sent_id = o.sent_id + 1""")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    ones = _groups(spark, d).where("num_group = 1").select("id", "doc_id", "sent_id", "content")
    return search.neighbours(ones).select("id", "prev", "next")


@register(QUERIES, "SELECT doc_id, coalesce(lead(text) OVER (PARTITION BY source ORDER BY doc_id), 'None') AS next FROM documents")
def next_row(spark: SparkSession, d: str) -> DataFrame:
    return search.next_text(table(spark, d, "documents").select("source", "doc_id", "text"), "doc_id", "text", ("source",)).select("doc_id", "next")


_HITS = f"""{_GROUPS}, {_INDEX}, hits AS (SELECT DISTINCT doc_id, sent_id, num_group FROM groups JOIN post USING (id) WHERE term = 'the')"""
_GREEDY = """ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, num_group ORDER BY sent_id) AS r FROM hits),
    greedy AS (SELECT doc_id, num_group, sent_id, r, sent_id AS last, TRUE AS keep FROM ordered WHERE r = 1
      UNION ALL SELECT o.doc_id, o.num_group, o.sent_id, o.r, CASE WHEN o.sent_id - g.last > o.num_group - 1 THEN o.sent_id ELSE g.last END, o.sent_id - g.last > o.num_group - 1
      FROM greedy g JOIN ordered o ON o.doc_id = g.doc_id AND o.num_group = g.num_group AND o.r = g.r + 1)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _groups(spark, d)
    return rows.where(F.array_contains(search.analyze(F.col("content")), "the")).select("doc_id", "sent_id", "num_group")


@register(QUERIES, f"WITH RECURSIVE {_HITS}, {_GREEDY} SELECT doc_id, num_group, sent_id FROM greedy WHERE keep")
def redundancy_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.without_overlap(_hits(spark, d))


@register(QUERIES, f"WITH {_HITS} SELECT doc_id, sent_id, min(num_group) AS num_group FROM hits GROUP BY 1, 2")
def keep_lowest_group(spark: SparkSession, d: str) -> DataFrame:
    return search.lowest_group(_hits(spark, d))


@register(QUERIES, f"WITH RECURSIVE {_HITS}, {_GREEDY} SELECT doc_id, sent_id, min(num_group) AS num_group FROM greedy WHERE keep GROUP BY 1, 2")
def non_redundant(spark: SparkSession, d: str) -> DataFrame:
    return search.non_redundant(_hits(spark, d))


@register(QUERIES, f"""WITH {_GROUPS}, {_INDEX}, {_ASKED}, {_BM25}, top AS (SELECT id, score + 1 AS score, cited_times, content FROM groups JOIN score USING (id) WHERE number_of_words >= 5 ORDER BY score DESC, cited_times DESC, id LIMIT 120),
    p AS (SELECT *, len(list_intersect(['the', 'thing', 'that', 'eran'], list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> ''))) / 4.0::DOUBLE AS hit FROM top)
    SELECT id, CASE WHEN cited_times > 0 THEN round((score + 0.1 * ln(cited_times)) * sqrt(hit), 5) END AS mix, CAST(round(hit * 4) AS INTEGER) AS hits FROM p""")
def mix_score_rank(spark: SparkSession, d: str) -> DataFrame:
    top = search.search(_groups(spark, d), QUERY)
    percent = T.percent_hit(search.analyze(F.lit(QUERY)), search.analyze(F.col("content")))
    rows = top.select("id", "cited_times", search.mix_score(F.col("score"), F.col("cited_times"), percent).alias("mix"), F.round(percent * 4).cast("int").alias("hits"))
    return rows.select("id", F.when(F.col("cited_times") > 0, F.round("mix", 5)).alias("mix"), "hits")


@register(QUERIES, f"WITH {_GROUPS} SELECT doc_id, string_agg(content, '. ' ORDER BY sent_id) AS text FROM groups WHERE num_group = 1 GROUP BY 1")
def full_section(spark: SparkSession, d: str) -> DataFrame:
    return search.section_of(_groups(spark, d), ("doc_id",)).select("doc_id", "text")


@register(QUERIES, f"""WITH {_GROUPS}, {_INDEX}, {_ASKED}, {_BM25}, top AS (SELECT id, content FROM groups JOIN score USING (id) WHERE number_of_words >= 5 ORDER BY score DESC, cited_times DESC, id LIMIT 120)
    SELECT id, '... ' || regexp_replace(content, '(?i)\\b(eran|that|the|thing)\\b', '<em>\\1</em>', 'g') || ' ...' AS shown FROM top""")
def highlighted(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_groups(spark, d), QUERY).select("id", search.highlight(F.col("content"), QUERY.split()).alias("shown"))


def word_separation(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents split by the costs of the thousand most frequent ones."""
    from ..functions import stem
    from ..operators import grams

    top = grams.top_grams(table(spark, d, "documents"), top={1: 1000})
    ranked = [r[0] for r in top.orderBy(F.desc("cnt"), "gram").select("gram").collect()]
    rows = table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", stem.separate(stem.word_costs(ranked), 20, F.col("text")).alias("text"))


#: Folders of indexes by application and input, each written once for all queries on it.
_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> str:
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = scratch(spark, "blocks")
        blockindex.write_blocks(_groups(spark, d), path)
        _INDEXES[key] = path
    return _INDEXES[key]


@register(QUERIES, QUERIES["bm25_topk"][1])
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """``bm25_topk`` from the stored index by block maxima."""
    return blockindex.search_blocks(spark, _index(spark, d), QUERY).select("id", F.round("score", 6).alias("score"))


@register(QUERIES, QUERIES["filtered_search"][1])
def filtered_index(spark: SparkSession, d: str) -> DataFrame:
    found = blockindex.search_blocks(spark, _index(spark, d), QUERY, section="en", journal="src3", min_year=1995, min_cited=10, max_group=2)
    return found.select("id", F.round("score", 6).alias("score"), "year", "cited_times")


@register(QUERIES, f"""WITH {_GROUPS}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '') AS w FROM groups)
    SELECT id, times FROM (SELECT id, len(list_filter(range(1, greatest(len(w), 1)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS times FROM w) WHERE times > 0""")
def phrase_index(spark: SparkSession, d: str) -> DataFrame:
    """Sentence groups with a phrase, from the positions of the stored index."""
    return blockindex.phrase_hits(spark, _index(spark, d), "of the")


for _f in (word_separation,):
    QUERIES[_f.__name__] = (_f, None)
