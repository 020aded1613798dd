"""Queries on keys, counts, sets and sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams, markov, relational, sparse, stats, vectors
from . import common as C
from .common import register, table

QUERIES: dict = {}


@register(QUERIES, "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_licensed(spark: SparkSession, d: str) -> DataFrame:
    return relational.present(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@register(QUERIES, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return relational.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register(QUERIES, "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_key_join(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_counts(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@register(QUERIES, "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    return relational.look_up(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", F.lit(-1))


@register(QUERIES, "SELECT source, doc_id // 1000 AS page, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY 1, 2")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.collect_pages(table(spark, d, "documents"), "source", "doc_id")
    return rows.select("source", "page", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@register(QUERIES, "SELECT DISTINCT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_keys(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "part").select(F.col("p_partkey").alias("k")))


@register(QUERIES, "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@register(QUERIES, "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


_MULTI = "SELECT c_nationkey AS k FROM customer {} ALL SELECT s_nationkey FROM supplier"


@register(QUERIES, _MULTI.format("INTERSECT"))
def multiset_common(spark: SparkSession, d: str) -> DataFrame:
    return relational.multiset_common(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"))


@register(QUERIES, _MULTI.format("EXCEPT"))
def multiset_removed(spark: SparkSession, d: str) -> DataFrame:
    return relational.multiset_common(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"), removed=True)


@register(QUERIES, "SELECT c_custkey AS key, coalesce(sum(o_totalprice)::DECIMAL(18,2), 0)::DOUBLE AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def keyed_sum(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    boxes = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    return relational.sum_by_key(keys, boxes).select("key", F.col("total").cast("double").alias("total"))


@register(QUERIES, "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Events whose work isn't done; those with an id divisible by three are."""
    events = table(spark, d, "events").select("event_id", "event_type")
    return relational.missing(events, events.where("event_id % 3 = 0"), "event_id")


@register(QUERIES, "SELECT CAST(event_id // 1000 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def id_bucket_flush(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(relational.flush_bucket(F.col("event_id"), size=1000).alias("bucket")).agg(F.count("*").alias("n"))


@register(QUERIES, "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


_RUNS = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


@register(QUERIES, f"SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM {_RUNS} GROUP BY user_id, event_id - i")
def adjacent_islands(spark: SparkSession, d: str) -> DataFrame:
    return relational.islands(table(spark, d, "events"), ["user_id"], "event_id")


@register(QUERIES, "SELECT value, max(i) AS idx FROM (SELECT unnest(w) AS value, unnest(range(len(w)))::INTEGER AS i FROM (SELECT " + C.words("text") + " AS w FROM documents)) GROUP BY 1")
def index_map(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import text as T

    return relational.index_map(table(spark, d, "documents").select(T.words(F.col("text")).alias("w")), "w")


@register(QUERIES, """SELECT e.event_id, p.value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
    ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""")
def as_of_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the user's latest purchase."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return relational.as_of(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "value").select("event_id", "value")


# Sequences

_STEPS = """steps AS (SELECT coalesce(lag(event_type) OVER w, '<START>') AS prev, event_type AS cur, lead(1) OVER w IS NULL AS fin FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    counts AS (SELECT prev, cur, count(*) AS cnt FROM (SELECT prev, cur FROM steps UNION ALL SELECT cur, '<END>' FROM steps WHERE fin) GROUP BY 1, 2)"""


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return markov.transition_counts(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@register(QUERIES, f"WITH {_STEPS} SELECT * FROM counts")
def markov_counts(spark: SparkSession, d: str) -> DataFrame:
    return _transitions(spark, d)


@register(QUERIES, f"WITH {_STEPS} SELECT prev, cur, round(cnt / sum(cnt) OVER (PARTITION BY prev), 9) AS p FROM counts")
def markov_normalized(spark: SparkSession, d: str) -> DataFrame:
    return markov.normalized(_transitions(spark, d)).select("prev", "cur", F.round("p", 9).alias("p"))


@register(QUERIES, f"WITH {_STEPS} SELECT prev, CAST(sum(cnt) AS BIGINT) AS top_sum FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY cnt DESC) AS r FROM counts) WHERE r <= 3 GROUP BY 1")
def markov_top_n_sum(spark: SparkSession, d: str) -> DataFrame:
    return grams.sum_top(_transitions(spark, d), "prev", "cnt", 3)


@register(QUERIES, """WITH steps AS (SELECT coalesce(lag(role) OVER w, '<START>') AS prev, role AS cur, lead(1) OVER w IS NULL AS fin FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT prev, cur, count(*) AS cnt FROM (SELECT prev, cur FROM steps UNION ALL SELECT cur, '<END>' FROM steps WHERE fin) GROUP BY 1, 2""")
def markov_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("s"))
    return markov.array_transitions(rows, "s")


# Term statistics

_TF = "tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: length(w) >= 2)) AS term FROM documents) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)"
_IDF = "ln((1 + n) / (1 + df)::DOUBLE) + 1"


@register(QUERIES, f"WITH {_TF} SELECT term, df, round({_IDF}, 6) AS idf, df < 5 AS is_stop FROM df, n")
def idf(spark: SparkSession, d: str) -> DataFrame:
    return stats.idf(table(spark, d, "documents"), min_df=5).select("term", "df", F.round("idf", 6).alias("idf"), "is_stop")


@register(QUERIES, f"""WITH {_TF}, w AS (SELECT id, term, tf * ({_IDF}) AS w FROM tf JOIN df USING (term), n WHERE df >= 5), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
    SELECT id, term, round(w / l, 6) AS weight FROM w JOIN l USING (id)""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return stats.tfidf(table(spark, d, "documents"), min_df=5).select("id", "term", F.round("weight", 6).alias("weight"))


#: Texts that a term of a co-occurrence table is in at least: the production value, whatever the size of the corpus.
MIN_DF = 100
_CO = f"{_TF}, kept AS (SELECT id, term, tf FROM tf JOIN df USING (term) WHERE df >= {MIN_DF}), co AS (SELECT a.term AS i, b.term AS j, sum(a.tf * b.tf) / (SELECT n FROM n)::DOUBLE AS c FROM kept a JOIN kept b ON a.id = b.id AND a.term <= b.term GROUP BY 1, 2)"


def _counted(spark: SparkSession, d: str) -> tuple[stats.Blocks, int]:
    """Counts of the terms in MIN_DF documents or more, and the number of documents."""
    docs = table(spark, d, "documents")
    return stats.counted(docs, min_df=MIN_DF), docs.count()


@register(QUERIES, f"WITH {_CO} SELECT i, j, round(c, 6) AS c FROM co")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Of all terms in MIN_DF documents or more."""
    return stats.cooccurrence(*_counted(spark, d)).select("i", "j", F.round("c", 6).alias("c"))


@register(QUERIES, f"WITH {_CO} SELECT co.i, co.j, round(greatest(0.0, log2(co.c) - log2(a.c) - log2(b.c)), 6) AS pmi FROM co JOIN co a ON a.i = a.j AND a.i = co.i JOIN co b ON b.i = b.j AND b.i = co.j")
def ppmi(spark: SparkSession, d: str) -> DataFrame:
    return stats.pmi_of_counts(*_counted(spark, d), positive=True).select("i", "j", F.round("pmi", 6).alias("pmi"))


def svd_ppmi(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen numbers for each term of the vocabulary: left singular vectors of its matrix of positive mutual information."""
    blocks, n = _counted(spark, d)
    met, found, values = sparse.symmetric_svd(stats.positive_information(blocks, n), blocks.terms, blocks.edges, 16)
    rows = pa.table({"term": blocks.terms.take(pa.array(met)), "vec": pa.array(list(found), pa.list_(pa.float64())), "largest": pa.array([values[0]] * len(met) if values else [], pa.float64())})
    return spark.createDataFrame(rows, "term string, vec array<double>, largest double")


QUERIES["svd_ppmi"] = (svd_ppmi, None)


@register(QUERIES, f"WITH {C.gram_counts((2,))}, top AS (SELECT gram FROM counts ORDER BY cnt DESC, gram LIMIT 200), rows AS (SELECT doc_id AS id, unnest({C.grams('w', 2)}) AS gram FROM (SELECT doc_id, {C.words('lower(' + C.marks_to_spaces('''regexp_replace(text, '[0-9]+', '', 'g')''') + ')')} AS w FROM documents)) SELECT id, gram, round(log2(count(*) + 1), 6) AS weight FROM rows JOIN top USING (gram) GROUP BY 1, 2")
def gram_features(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    vocab = grams.top_grams(docs, top={2: 200})
    return stats.gram_features(docs, vocab).select("id", "gram", F.round("weight", 6).alias("weight"))


@register(QUERIES, f"SELECT DISTINCT unnest({C.words('lower(text)')}) AS word FROM documents")
def distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary_words(table(spark, d, "documents"))
