"""Queries on vectors, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, cells, cluster, similar, smallworld, stats, vectors
from ..session import scratch
from . import common as C
from .common import register, table

QUERIES: dict = {}

_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@register(QUERIES, f"SELECT e.vec_id AS id, round({_L2.format('e.embedding', 'q.embedding')}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_L2.format('e.embedding', 'q.embedding')}, 1 LIMIT 20")
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_one(table(spark, d, "embeddings"), _vector(spark, d, 7), 20).select("id", F.round("distance", 6).alias("distance"))


@register(QUERIES, f"""SELECT query_id, id, round(distance, 6) AS distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) AS INTEGER) AS rank
    FROM (SELECT e.vec_id, q.vec_id, {_L2.format('e.embedding', 'q.embedding')} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) x(evec, qvec, distance), LATERAL (SELECT evec AS vec_id) e, LATERAL (SELECT qvec AS vec_id) q) WHERE rank <= 10""")
def knn_batch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest rows of every vector whose id is divisible by 100."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    return vectors.nearest(rows, asked, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


_UNIT = f"unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_DOT.format('embedding', 'embedding')})) AS u FROM embeddings)"
#: Cosine from which two vectors of a label are linked.
LEAST = 0.3
_LINKS = f"""classes AS (SELECT label AS block, u, embedding, min(vec_id) AS rep, count(*) AS size FROM unit JOIN embeddings USING (vec_id, label) GROUP BY 1, 2, 3),
    links AS (SELECT a.block, a.rep AS i, b.rep AS j, round({_DOT.format('a.u', 'b.u')}, 6) AS sim FROM classes a JOIN classes b ON a.block = b.block AND a.rep < b.rep WHERE round({_DOT.format('a.u', 'b.u')}, 6) >= {LEAST})"""


@register(QUERIES, f"WITH {_UNIT}, {_LINKS} SELECT block, i, j, sim FROM links UNION ALL SELECT label, rep, vec_id, 1.0::DOUBLE FROM embeddings e JOIN classes c ON e.label = c.block AND e.embedding = c.embedding")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a label from LEAST on between representatives of equal vectors, and each vector under its
    representative with similarity one."""
    rows = table(spark, d, "embeddings")
    found, linked = similar.similarity_join(rows, LEAST)
    members = similar.membership(rows, found).select("grp", F.col("rep").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("sim"))
    return linked.unionByName(members).withColumnRenamed("grp", "block")


_LADDER = "CASE WHEN s > 0.95 THEN s WHEN s > 0.6 THEN 0.95 WHEN s > 0.5 THEN 0.9 WHEN s > 0.4 THEN 0.8 WHEN s > 0.35 THEN 0.7 WHEN s > 0.3 THEN 0.6 WHEN s > 0.25 THEN 0.5 WHEN s > 0.2 THEN 0.4 WHEN s > 0.15 THEN 0.3 ELSE 0.2 END"


@register(QUERIES, f"""WITH {_UNIT}, {_LINKS}, whole AS (SELECT a.label AS block, a.vec_id AS i, list_reverse_sort(list(round({_DOT.format('a.u', 'b.u')}, 6)))[2] AS s FROM unit a JOIN unit b ON a.label = b.label GROUP BY 1, 2),
    f AS (SELECT block, i, ({_LADDER}) / s AS f FROM whole)
    SELECT l.block, l.i, l.j, round((least(1.0, sim * a.f) + least(1.0, sim * b.f)) / 2, 6) AS sim FROM links l JOIN f a ON a.block = l.block AND a.i = l.i JOIN f b ON b.block = l.block AND b.i = l.j""")
def similarity_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Links of a label from LEAST on, adjusted by the second-largest entries of both rows of the label's whole matrix."""
    found, linked = similar.similarity_join(table(spark, d, "embeddings"), LEAST)
    return similar.adjusted_links(found, linked).select(F.col("grp").alias("block"), "i", "j", F.round("sim", 6).alias("sim"))


@register(QUERIES, f"""WITH {_UNIT}, s AS (SELECT a.label AS block, a.vec_id AS i, round(sum({_DOT.format('a.u', 'b.u')}), 6) AS s FROM unit a JOIN unit b ON a.label = b.label GROUP BY 1, 2)
    SELECT block, i AS center FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY s DESC, i) AS r FROM s) WHERE r = 1""")
def medoid_per_label(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cosine_medoids(table(spark, d, "embeddings")).withColumnRenamed("label", "block")


@register(QUERIES, "SELECT label, vec_id // 1000 AS page, array_to_string(list_sort(list(vec_id)), ',') AS ids FROM embeddings GROUP BY 1, 2")
def cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    return cluster.members(table(spark, d, "embeddings")).select("label", "page", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_SET = f"list_distinct(flatten(list_transform(list_distinct(list_filter({C.words('lower({})')}, lambda w: w NOT IN ('a', 'an', 'the'))), lambda w: list_transform(range(1, greatest(length(w) - 4, 1) + 1), lambda i: CASE WHEN length(w) < 5 THEN w ELSE substr(w, i, 5) END))))"
_CLEAN = C.squeeze("regexp_replace(" + C.marks_to_spaces(C.strip("text")) + ", '[^a-zA-Z0-9_.]+', ' ', 'g')")


@register(QUERIES, f"""WITH q AS (SELECT {_SET.format('text')} AS q FROM benchmark WHERE item_id = 0), e AS (SELECT vec_id AS id, {_L2.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 100),
    h AS (SELECT id, distance, {_SET.format(_CLEAN)} AS s FROM e JOIN documents ON doc_id = id)
    SELECT id, round(distance, 6) AS distance, round(CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, s)) / len(q)::DOUBLE END, 6) AS score FROM h, q""")
def evidence_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest segments of a query vector, ranked anew by their coverage of the query's text."""
    near = vectors.nearest_one(table(spark, d, "embeddings"), _vector(spark, d, 7), 100)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("segment"))
    query = table(spark, d, "benchmark").where("item_id = 0").first()["text"]
    found = vectors.rerank(near.join(texts, "id"), query)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register(QUERIES, f"SELECT vec_id AS id, round({_L2.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) AS distance, doc_id FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY {_L2.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 1 LIMIT 100")
def evidence_by_distance(spark: SparkSession, d: str) -> DataFrame:
    """Segments in the order of their distance from a query vector."""
    near = vectors.nearest_one(table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id"), _vector(spark, d, 7), 100)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("segment"))
    return vectors.rerank(near.join(texts, "id"), "", by="distance").select("id", F.round("distance", 6).alias("distance"), F.col("id").alias("doc_id"))


def _vectors(words: DataFrame) -> DataFrame:
    """A word table whose vectors follow from the words: eight numbers from their MD5."""
    part = lambda i: (F.conv(F.substring(F.md5("word"), 1 + 4 * i, 4), 16, 10).cast("double") - 32767.5) / 32767.5
    return words.select("word", F.array(*[part(i) for i in range(8)]).alias("vec"))


_NUM = "(('0x' || substr(md5(word), {0}, 4))::INTEGER - 32767.5) / 32767.5"


@register(QUERIES, f"""WITH t AS (SELECT doc_id AS id, word, count(*) AS tf FROM (SELECT doc_id, unnest({C.words('lower(text)')}) AS word FROM documents) GROUP BY 1, 2),
    df AS (SELECT term AS word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) >= 2))) AS term FROM documents) GROUP BY 1),
    w AS (SELECT word, CASE WHEN word IN ('a', 'an', 'the') THEN 0 ELSE coalesce(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1, 0) END AS weight FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word)),
    v AS (SELECT word, [{", ".join(_NUM.format(1 + 4 * i) for i in range(8))}] AS v FROM (SELECT DISTINCT word FROM t)),
    x AS (SELECT id, d, sum(tf * weight * v[d] / sqrt({_DOT.format('v', 'v')})) AS x FROM t JOIN w USING (word) JOIN v USING (word), (SELECT unnest(range(1, 9)) AS d) WHERE weight <> 0 GROUP BY 1, 2),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)
    SELECT doc_id AS id, CAST(d - 1 AS INTEGER) AS d, round(CASE WHEN n.n IS NULL OR n.n = 0 THEN 0.0 ELSE x.x / n.n END, 5) AS x FROM documents CROSS JOIN (SELECT unnest(range(1, 9)) AS d) LEFT JOIN x ON x.id = doc_id AND x.d = d LEFT JOIN n ON n.id = doc_id""".replace("LEFT JOIN x ON x.id = doc_id AND x.d = d LEFT", "LEFT JOIN x ON x.id = doc_id AND x.d = g.d LEFT").replace("CROSS JOIN (SELECT unnest(range(1, 9)) AS d) LEFT", "CROSS JOIN (SELECT unnest(range(1, 9)) AS d) g LEFT").replace("CAST(d - 1", "CAST(g.d - 1"))
def sentence_embed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lut = similar.stored(_vectors(stats.vocabulary_words(docs)), "words")
    weights = vectors.word_weights(lut.select("word"), stats.idf(docs), ("a", "an", "the"), 0.0)
    return vectors.embed_texts(docs, lut, weights, size=8).select("id", F.posexplode("vec").alias("d", "x")).select("id", "d", F.round("x", 5).alias("x"))


_PIECES = "SELECT " + C.words("piece") + " AS tokens FROM (SELECT unnest(regexp_split_to_array(lower(text), '[.\\n]+')) AS piece FROM {0})"


@register(QUERIES, f"""WITH base AS (SELECT array_to_string(tokens, ' ') AS sentence, tokens, count(*) AS copies FROM ({_PIECES.format('conversations')}) WHERE len(tokens) > 0 GROUP BY tokens),
    asked AS (SELECT DISTINCT array_to_string(tokens, ' ') AS query, tokens FROM ({_PIECES.format('benchmark WHERE item_id % 100 = 0')}) WHERE len(tokens) > 0),
    qw AS (SELECT query, w, count(*) AS c FROM (SELECT query, unnest(tokens) AS w FROM asked) GROUP BY 1, 2), sw AS (SELECT sentence, w, count(*) AS c FROM (SELECT sentence, unnest(tokens) AS w FROM base) GROUP BY 1, 2),
    v AS (SELECT w, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS u FROM (SELECT w, [{", ".join(_NUM.format(1 + 4 * i).replace("word", "w") for i in range(8))}] AS v FROM (SELECT w FROM qw UNION SELECT w FROM sw))),
    sims AS (SELECT a.w AS a, b.w AS b, {_DOT.format('a.u', 'b.u')} AS sim FROM v a, v b WHERE a.w IN (SELECT w FROM qw) AND b.w IN (SELECT w FROM sw)),
    pairs AS (SELECT query, sentence, qw.w AS a, qw.c AS ac, sw.w AS b, sw.c AS bc, sim FROM qw, sw, sims WHERE sims.a = qw.w AND sims.b = sw.w),
    front AS (SELECT query, sentence, sum(ac * best) AS s FROM (SELECT query, sentence, a, ac, max(sim) AS best FROM pairs GROUP BY ALL) GROUP BY ALL),
    back AS (SELECT query, sentence, sum(bc * best) AS s FROM (SELECT query, sentence, b, bc, max(sim) AS best FROM pairs GROUP BY ALL) GROUP BY ALL),
    common AS (SELECT query, sentence, sum(CASE WHEN a = b THEN least(ac, bc) ELSE 0 END) AS c FROM pairs GROUP BY ALL),
    scored AS (SELECT query, sentence, copies, least(len(asked.tokens), len(base.tokens)) AS d, c, CASE WHEN len(asked.tokens) < len(base.tokens) THEN front.s ELSE back.s END AS s
        FROM common JOIN front USING (query, sentence) JOIN back USING (query, sentence) JOIN asked USING (query) JOIN base USING (sentence)),
    final AS (SELECT query, sentence, copies, round((s / d * (d - c) + c) / d, 6) AS sim FROM scored)
    SELECT query, sentence, sim, copies, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, sentence) AS rank FROM final) WHERE rank <= 10""")
def sentence_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Ten sentences of all conversations most like each sentence of the benchmark's items divisible by 100, by aligned words."""
    pieces = lambda df: df.select(F.explode(F.split(F.lower("text"), "[.\\n]+")).alias("piece")).select(T.words(F.col("piece")).alias("tokens")).where(F.size("tokens") > 0)
    asked, base = pieces(table(spark, d, "benchmark").where("item_id % 100 = 0")), pieces(table(spark, d, "conversations"))
    words = asked.unionByName(base).select(F.explode("tokens").alias("word")).distinct()
    return align.compare(base, asked, _vectors(words), 10)


# Rows only


def kmeans_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return cluster.predict(cluster.fit_kmeans(rows, 10), rows).select("vec_id", "label", "cluster")


def word2vec_embed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(T.words(F.lower("text")).alias("tokens"))
    return cluster.train_words(docs, size=16, least=50)


def lsh_knn(spark: SparkSession, d: str) -> DataFrame:
    return cluster.approximate_nearest(table(spark, d, "embeddings"), _vector(spark, d, 7), 20)


def ivf_knn(spark: SparkSession, d: str) -> DataFrame:
    """Ten near rows of every vector whose id is divisible by 100, from the 40 nearest of 64 stored cells."""
    rows, path = table(spark, d, "embeddings"), scratch(spark, "cells")
    cells.write_cells(rows, path, cells=64)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return cells.search_cells(spark, path, asked, 10, probes=40).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def svd_embed(spark: SparkSession, d: str) -> DataFrame:
    return cluster.svd(table(spark, d, "embeddings"), 8)[0]


def pca_embed(spark: SparkSession, d: str) -> DataFrame:
    return cluster.pca(table(spark, d, "embeddings"), 8)[0].select("vec_id", "pc")


def random_projection(spark: SparkSession, d: str) -> DataFrame:
    """Eight numbers of each vector by the seeded matrix."""
    rows = vectors.random_projection(table(spark, d, "embeddings"), 8).select("vec_id", F.posexplode("embedding").alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 5).alias("x"))


def agglomerative_small(spark: SparkSession, d: str) -> DataFrame:
    """Three clusters of each label's vectors, by single linkage."""
    return cluster.single_linkage(table(spark, d, "embeddings"), 3).select("grp", "id", "cluster")


def graph_knn(spark: SparkSession, d: str) -> DataFrame:
    """Ten near rows of every vector whose id is divisible by 100, by the small-world graphs of all blocks."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    return smallworld.search(smallworld.build(rows), asked, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _projection_sql(dim: int = 64, size: int = 8) -> str:
    m = vectors.projection_matrix(dim, size)
    dots = ", ".join(f"list_sum(list_transform(list_zip(embedding, {[float(x) for x in r]}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))" for r in m)
    return f"SELECT vec_id, CAST(d AS INTEGER) AS d, round(v[d + 1], 5) AS x FROM (SELECT vec_id, [{dots}] AS v FROM embeddings), (SELECT unnest(range({size})) AS d)"


for _f in (kmeans_embed, word2vec_embed, lsh_knn, ivf_knn, graph_knn, svd_embed, pca_embed, agglomerative_small):
    QUERIES[_f.__name__] = (_f, None)
QUERIES["random_projection"] = (random_projection, _projection_sql())
