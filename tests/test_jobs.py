from pyspark.sql import functions as F

from inkwell.operators import corpus, stats
from inkwell.plans import jobs


def test_selection(spark):
    licences = spark.createDataFrame([("f", "J of X", "1", "d", "11", "CC"), ("f", "J of X", "2", "d", "12", "CC"), ("f", "Y", "3", "d", "13", "CC")], "file_loc string, journal_name string, pmcid string, modified_date string, pmid string, license_type string")
    ids = jobs.subject_ids(jobs.journal_index(licences), spark.createDataFrame([("J of X",)], "journal string"))
    assert {r.id for r in ids.collect()} == {"1", "2"}
    edges = spark.createDataFrame([("1", "3"), ("1", "9")], "src string, dst string")
    assert {r.id for r in jobs.related_papers(edges, ids, licences).collect()} == {"3"}
    files = spark.createDataFrame([("PMC1.nxml",), ("PMC7_0.nxml",)], "name string")
    here, gone = jobs.local_and_missing(ids, files, spark.createDataFrame([("1", "t")], "pmcid string, title string"))
    assert [r.title for r in here.collect()] == ["t"] and [r.id for r in gone.collect()] == ["2"]


def test_example_sentences_to_search(spark):
    papers = spark.createDataFrame([("1", "T", "J", "2001", 5), ("2", "U", "J", "1999", 0)], "pmcid string, title string, journal string, year string, cited_times int")
    text = "The quick fox runs over hills. The slow dog sleeps in the sun. A quick fox and a slow dog meet."
    articles = spark.createDataFrame([("1", f"<title>Methods</title>{text}<title>Results</title>More of it here now. <title>Discussion</title>")], "pmcid string, nxml string")
    groups = jobs.example_sentences(papers, articles, 1, "c")
    assert groups.count() == 4 and {r.section for r in groups.collect()} == {"Methods", "Results"}
    index = jobs.build_index(groups.unionByName(groups))
    assert index.count() == 4
    found = jobs.example_search(index, "quick fox", section="Methods").collect()
    assert {r.sent_id: r.next[:8] for r in found} == {0: "The slow", 2: ""} and found[0].mix >= found[1].mix


def test_evidence(spark):
    rows = spark.createDataFrame([(1, 0, "cats purr"), (1, 1, "dogs bark"), (1, 2, "cats and dogs")], "doc_id int, sent_id int, content string")
    lut = spark.createDataFrame([("cats", [1.0, 0.0]), ("dogs", [0.0, 1.0]), ("purr", [0.9, 0.1]), ("bark", [0.1, 0.9])], "word string, vec array<double>")
    idf = stats.idf(rows, "content")
    store = jobs.segment_store(rows, lut, idf)
    got = jobs.evidence(store, "cats purr", lut, idf).collect()
    assert got[0].segment == "cats purr." and got[0].distance < 1e-9 and len(got) == 3


def test_phrases_to_transitions(spark):
    rows = spark.createDataFrame([(1, 0, "genes have shown growth"), (1, 1, "cells are known to grow"), (1, 2, "it")], "doc_id int, pos int, sentence string")
    phrases = jobs.phrase_sequence(jobs.extract_phrases(rows))
    got = {r.pos: r.phrase for r in phrases.collect()}
    assert set(got) == {0, 1} and got[0].startswith("have shown")
    lut = spark.createDataFrame([("have", [1.0, 0.0]), ("shown", [1.0, 0.1]), ("are", [0.0, 1.0]), ("known", [0.1, 1.0])], "word string, vec array<double>")
    idf = stats.idf(rows, "sentence")
    counts, p = jobs.phrase_transitions(phrases, jobs.fit_phrases(phrases, lut, idf, 2), lut, idf)
    assert counts.agg(F.sum("cnt")).first()[0] == 3 and p.agg(F.max("p")).first()[0] == 1.0


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "This is a sufficiently long sentence about wang and his growing cells in 2001. Short. 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7")], "doc_id int, text string")
    got = corpus.clean_documents(docs, stop="small").collect()
    assert len(got) == 1 and "be" in got[0].tokens and "wang" not in got[0].tokens and "p_r_o_n_o_u_n" in [t.lower() for t in got[0].tokens]
    kept = corpus.curate(spark.createDataFrame([("the dog is running fast",)], "sentence string"), stop="whole", stemmer="porter").first().tokens
    assert "run" in kept and "is" not in kept


def test_citations(spark):
    numbers, counts, texts = jobs.number_citations(spark.createDataFrame([(1, "Results", "[&b&]"), (1, "Abstract", "[&a&]")], "doc_id int, section string, text string"))
    assert {r.ref: r.idx for r in numbers.collect()} == {"a": 1, "b": 2} and counts.count() == 2 and {r.text for r in texts.collect()} == {"[1]", "[2]"}


def test_titles_vocabulary_and_idf(spark):
    article = '<PubmedArticle><ArticleId IdType="pubmed">7</ArticleId><ArticleTitle>On cells</ArticleTitle><Abstract>They grow.</Abstract></PubmedArticle>'
    links = spark.createDataFrame([("<LinkSet><IdList><Id>7</Id></IdList></LinkSet>",)], "xml string")
    rows = jobs.title_records(spark.createDataFrame([(article,)], "xml string"), links)
    r = rows.first()
    assert (r.pmid, r.title, r.abstract, r.num_cited) == ("7", "On cells", "They grow.", 1)
    assert jobs.project_titles(rows, "for_display").first().text == "On cells\nThey grow."
    docs = spark.createDataFrame([("cells grow cells",), ("the cells",)], "text string")
    assert jobs.subject_vocabulary(docs, "bio").first().unigram_freq == {"cells": 3, "grow": 1}
    found = {r.term: r.is_stop for r in jobs.idf_table(docs, 1, "whole", "text").collect()}
    assert found == {"cells": False, "grow": False, "the": True}
    assert {r.term: r.is_stop for r in jobs.idf_table(docs, 2, "none", "text").collect()} == {"cells": False, "grow": True, "the": True}
    said = spark.createDataFrame([(1, 0, "A cat can go"), (1, 1, "cat can go"), (1, 2, "References"), (1, 3, "cat")], "doc_id int, pos int, sentence string")
    assert {(r.pos, r.noun): r.suggestion for r in jobs.suggest_determiners(said).collect()}[1, "cat"] == "this" and jobs.suggest_determiners(said).where("pos > 1").count() == 0
