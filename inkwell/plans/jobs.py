"""The batch jobs and service calls, one function each, from tables to tables."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import biblio, chunk, cluster, corpus, determiners, grams, graph, markov, records, relational, search, sections, stats, vectors
from ..sources import readers, writers

# Corpus selection


def journal_index(licences: DataFrame) -> DataFrame:
    """(journal, pmcids): papers of each journal."""
    return relational.collect_groups(licences, "journal_name", "pmcid").select(F.col("journal_name").alias("journal"), F.col("values").alias("pmcids"))


def subject_ids(index: DataFrame, journals: DataFrame) -> DataFrame:
    """(id): papers of a subject's journals."""
    return relational.by_journal(index, journals).select(F.explode("pmcids").alias("id")).distinct()


def related_papers(edges: DataFrame, seeds: DataFrame, licences: DataFrame, degree: int = 1) -> DataFrame:
    """(id): papers so many citations away that are licensed."""
    return relational.present(graph.expand(edges, seeds, degree), licences.select(F.col("pmcid").alias("id")), "id")


def local_and_missing(ids: DataFrame, files: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of papers that are here, and ids of those that aren't."""
    here = files.select(F.regexp_extract("name", r"^PMC(.*?)(?:_\d+)?\.nxml$", 1).alias("id")).distinct()
    return info.join(relational.present(ids, here, "id").select(F.col("id").alias("pmcid")), "pmcid"), relational.missing(ids, here, "id")


# Records and sentences


def title_records(xml: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    return records.parse_articles(records.split_articles(xml), records.link_counts(links, strict=strict), strict)


def project_titles(rows: DataFrame, mode: str) -> DataFrame:
    return rows.select("pmid", records.project_mode(F.col("title"), F.col("abstract"), mode).alias("text"))


def example_sentences(papers: DataFrame, articles: DataFrame, num_group: int, collection: str) -> DataFrame:
    """Sentence groups of a collection's papers in the index's form."""
    joined = readers.with_articles(papers, articles).withColumn("doc_id", F.xxhash64("pmcid"))
    keep = ("pmcid", "title", "journal", "year", "cited_times", "doc_id")
    rows = sections.article_groups(joined, num_group, keep=keep)
    return rows.select(F.lit(collection).alias("_index"), F.col("pmcid").alias("PMCID"), "title", "journal", "year", "cited_times", "number_of_words", "doc_id", "sent_id", "section", "content", "num_group")


def build_index(groups: DataFrame) -> DataFrame:
    """Groups with their content ids, equal contents once."""
    return writers.upserted(groups.withColumn("__seq", F.monotonically_increasing_id()), "__seq").drop("__seq")


def subject_vocabulary(docs: DataFrame, subject: str) -> DataFrame:
    return grams.vocabulary(docs, subject)


def idf_table(sentences: DataFrame, min_df: int, stop: str = "whole", text_col: str = "sentence") -> DataFrame:
    """Terms with idf; the option's words count as stop words too."""
    listed = corpus.stopwords(stop)
    found = stats.idf(sentences, text_col, min_df)
    return found.withColumn("is_stop", F.col("is_stop") | F.col("term").isin(*listed)) if listed else found


# Evidence and example search


def segment_store(sentences: DataFrame, lut: DataFrame, idf: DataFrame, num_group: int = 1) -> DataFrame:
    """(doc_id, member_ids, segment, seg_id, vec): embedded groups of neighbouring sentences."""
    groups = vectors.segment_groups(sentences, num_group).withColumn("seg_id", F.xxhash64("doc_id", "member_ids"))
    n = sentences.count()
    stop = idf.where("is_stop").select(F.col("term").alias("word"))
    weights = vectors.word_weights(lut.select("word"), idf, (), math.log(max(1, n))).join(stop, "word", "left_anti")
    vecs = vectors.embed_texts(groups.select("seg_id", T.clean_query(F.col("segment")).alias("text")), lut, weights, "seg_id")
    return groups.join(vecs.withColumnRenamed("id", "seg_id"), "seg_id")


def evidence(store: DataFrame, query: str, lut: DataFrame, idf: DataFrame, k: int = 1000, by: str = "coverage", size: int = 100) -> DataFrame:
    """(id, distance, segment, score): nearest segments of a query, ranked anew."""
    spark = store.sparkSession
    asked = spark.range(1).select(F.lit(0).alias("doc_id"), T.clean_query(F.lit(query)).alias("text"))
    weights = vectors.word_weights(lut.select("word"), idf.where("NOT is_stop"))
    vec = vectors.embed_texts(asked, lut, weights).first()["vec"]
    near = vectors.nearest_one(store, vec, k, "seg_id", "vec")
    return vectors.rerank(near.join(store.select(F.col("seg_id").alias("id"), "segment"), "id"), query, by, size)


def example_search(groups: DataFrame, term: str, **conditions) -> DataFrame:
    """Example sentences for a term: found, freed of overlap, with neighbours, by mixed score."""
    words = len(search_words(term))
    conditions.setdefault("max_group", K.GROUPS_FOR_WORDS[min(max(words, 1), 7)])
    hits = search.search(groups, term, **conditions)
    kept = hits.join(search.non_redundant(hits), ["doc_id", "sent_id", "num_group"])
    percent = T.percent_hit(search.analyze(F.lit(term)), search.analyze(F.col("content")))
    mixed = kept.withColumn("mix", search.mix_score(F.col("score"), F.col("cited_times"), percent))
    singles = groups.select("doc_id", "section", "num_group", "sent_id", F.col("content").alias("c"))
    near = lambda name, by: singles.select("doc_id", "section", "num_group", (F.col("sent_id") + by).alias("sent_id"), F.col("c").alias(name))
    on = ["doc_id", "section", "num_group", "sent_id"]
    return mixed.join(near("prev", 1), on, "left").join(near("next", -1), on, "left").fillna("", ["prev", "next"]).orderBy(F.desc("mix"), "id")


def search_words(term: str) -> list[str]:
    return term.split()


# Phrases


def extract_phrases(sentences: DataFrame, label: str = "VP", keep=("doc_id", "pos"), text_col: str = "sentence", tagger: chunk.Tagger = chunk.rule_tagger) -> DataFrame:
    """(keep, phrases): phrases of each sentence as arrays of words, neighbours joined."""
    rows = sentences.where(F.length(text_col) > 5).select(*keep, chunk.chunk(chunk.tag(F.col(text_col), tagger), label).alias("c"))
    found = rows.select(*keep, chunk.extract(F.col("c"), label, join_neighbours=True).alias("p"))
    return found.select(*keep, F.transform("p", lambda x: F.transform(x, lambda w: w["word"])).alias("phrases"))


def phrase_sequence(phrases: DataFrame, mode: str = "fpo", keep=("doc_id", "pos")) -> DataFrame:
    """(keep, part, phrase): phrases in the mode's form, as texts in order."""
    return phrases.select(*keep, F.posexplode(chunk.phrase_modes(F.col("phrases"), mode)).alias("part", "w")).select(*keep, "part", T.phrase_text(F.col("w")).alias("phrase"))


def fit_phrases(phrases: DataFrame, lut: DataFrame, idf: DataFrame, k: int) -> KMeansModel:
    """Clusters of distinct phrases by their embeddings."""
    vecs = _phrase_vectors(phrases, lut, idf)
    return cluster.fit_kmeans(vecs, k, "vec")


def _phrase_vectors(phrases: DataFrame, lut: DataFrame, idf: DataFrame) -> DataFrame:
    distinct = phrases.select(F.col("phrase").alias("doc_id"), F.col("phrase").alias("text")).where("text <> ''").distinct()
    return vectors.embed_texts(distinct, lut, vectors.word_weights(lut.select("word"), idf.where("NOT is_stop")))


def phrase_transitions(phrases: DataFrame, model: KMeansModel, lut: DataFrame, idf: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Counts and probabilities of the steps between phrase clusters within documents."""
    placed = cluster.predict(model, _phrase_vectors(phrases, lut, idf), "vec").select(F.col("id").alias("phrase"), F.col("cluster").cast("string").alias("state"))
    rows = phrases.join(placed, "phrase")
    counts = markov.transition_counts(rows, doc, "state", "pos", "part")
    return counts, markov.normalized(counts)


def suggest_determiners(sentences: DataFrame, **columns: str) -> DataFrame:
    """Suggestions for sentences before the references."""
    return determiners.suggest(sections.until_references(sentences, **columns), **{("text" if k == "sentence" else k): v for k, v in columns.items()})


# Citations


def number_citations(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, counts, texts): references numbered by first use, counted by section, and put in the texts."""
    uses = biblio.reference_uses(texts)
    numbers = biblio.number_references(uses)
    return numbers, biblio.count_references(uses), biblio.substitute_references(texts, numbers)
