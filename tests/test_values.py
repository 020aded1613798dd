"""Values of readers, writers and functions that no query shows, and of approximate methods against exact ones."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import constants as K
from inkwell.functions import text as T
from inkwell.operators import biblio, chunk, cluster, corpus, determiners, graph, grams, records, relational, search, sections, smallworld, stats, vectors
from inkwell.plans import queries
from inkwell.sources import readers, writers
from inkwell.streaming import incremental

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def words(*ws):
    return F.array(*map(F.lit, ws))


# Sources


def test_folders_and_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", " one \ntwo  x\n"), ("b.nxml", "<x>"), ("sub/c.txt", ""), ("sub/b.nxml", "later")):
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    assert {(r.name, r.size) for r in readers.listing(spark, root, "*.txt").collect()} == {("a.txt", 13)}
    assert {r.name for r in readers.listing(spark, root, "*.txt", recursive=True, least=-1).collect()} == {"a.txt"}  # empty files are no rows
    assert {r.name for r in readers.listing(spark, root, "*", recursive=True, least=4).collect()} == {"a.txt", "b.nxml"}
    assert {(r.name, r.text) for r in readers.files(spark, root, "*.txt", True).collect()} == {("a.txt", " one \ntwo  x\n")}
    assert [r.line for r in readers.lines(spark, f"{root}/a.txt").collect()] == ["one", "two  x"]
    assert readers.joined_lines(spark, f"{root}/a.txt").first().text == "one two  x "
    assert [r.tokens for r in readers.token_lines(spark, f"{root}/a.txt").collect()] == [["one"], ["two", "x"]]
    writers.flat_copy(spark, root, f"{root}/flat", "*.nxml")
    assert {(r.name, bytes(r.content)) for r in spark.read.parquet(f"{root}/flat").collect()} in ({("b.nxml", b"<x>")}, {("b.nxml", b"later")})


def test_record_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "j.csv").write_text("Rank;Title\n1;Journal of A\n2;B\n")
    assert [r.journal for r in readers.journals(spark, f"{root}/j.csv").collect()] == ["Journal of A", "B"]
    rows = frame(spark, [("1", "On some things", "J of X", "J X", "2001", "May", "", 7), ("2", "T", "J", "J", "1999", "1", "2", 0)], "pmcid string, title string, journal string, journal_abbrev string, year string, month string, day string, cited_times int")
    writers.write_paper_info(rows, f"{root}/info")
    (tmp_path / "info" / "part-more.txt").write_text("too few fields\n")
    got = {tuple(r) for r in readers.paper_info(spark, f"{root}/info").collect()}
    assert got == {("1", "On some things", "J of X", "J X", "2001", "May", "N/A", 7), ("2", "T", "J", "J", "1999", "1", "2", 0)}
    assert [r.value for r in readers.bad_paper_info(spark, f"{root}/info").collect()] == ["too few fields"]


def test_json_forms(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = frame(spark, [(1, 0, "a."), (1, 1, "b."), (2, 0, "c.")], "doc_id long, sent_id int, content string")
    writers.write_group_arrays(rows, f"{root}/groups")
    got = readers.group_arrays(spark, f"{root}/groups", "doc_id bigint, sent_id int, content string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    lines = [json.loads(r.value) for r in spark.read.text(f"{root}/groups").collect()]
    assert sorted(len(x) for x in lines) == [1, 2]
    doc = frame(spark, [("s", {"a": 1}, [("p", 2)])], "subject string, freq map<string,int>, e array<struct<w:string,n:int>>")
    writers.write_document(doc, f"{root}/doc")
    back = readers.document(spark, f"{root}/doc").first()
    assert (back.subject, back.freq.a, back.e[0].w, back.e[0].n) == ("s", 1, "p", 2)
    assert readers.point(rows, "doc_id", 2).first().content == "c."


def test_text_outputs(spark, tmp_path):
    root = f"file://{tmp_path}"
    writers.write_lines(frame(spark, [(["a", "b"],), ([],)], "t array<string>"), f"{root}/tokens", tokens="t")
    assert sorted(r.value for r in spark.read.text(f"{root}/tokens").collect()) == [" ", "a b "]
    writers.write_lines(frame(spark, [("x y",)], "t string"), f"{root}/texts", text="t")
    assert [r.value for r in spark.read.text(f"{root}/texts").collect()] == ["x y "]
    rows = frame(spark, [(0, "a"), (1, "b"), (0, "c")], "cluster int, text string")
    writers.write_clusters(rows, f"{root}/clusters")
    assert {(r.cluster, r.value) for r in spark.read.text(f"{root}/clusters").collect()} == {(0, "a"), (1, "b"), (0, "c")}
    (tmp_path / "s.txt").write_text("One. Two (x). Three")
    assert [r.sentence for r in readers.sentence_text(spark, f"{root}/s.txt").collect()] == ["One", "Two (x)", "Three"]
    assert readers.sentence_text(spark, f"{root}/s.txt", "lb").first().sentence == "One Two x Three"
    pdf = frame(spark, [("p", bytearray(b"\xc3\xa9")), ("q", bytearray(b"\xff"))], "path string, content binary")
    assert {r.path: r.text for r in readers.decoded(pdf).collect()} == {"p": "é", "q": None}
    assert {r.path: r.text for r in readers.decoded(pdf, lambda b: str(len(b))).collect()} == {"p": "2", "q": "1"}


def test_unreadable_parts_of_articles(spark, tmp_path):
    for name, text in (("1.nxml", "whole"), ("2_0.nxml", "a"), ("2_1.nxml", "b"), ("2_3.nxml", "after a gap")):
        (tmp_path / name).write_text(text)
    found = readers.articles(spark, f"file://{tmp_path}")
    papers = frame(spark, [("1",), ("2",), ("9",)], "pmcid string")
    assert {r.pmcid: r.nxml for r in readers.with_articles(papers, found).collect()} == {"1": "whole", "2": "a \nb \n", "9": None}


# Filters and text functions


def test_token_filters(spark):
    r = values(spark, short=T.drop_short(words("a", "bcd", "bcde"), 3), single=T.drop_single(words("x", "a", "5", "ab")), data=T.drop_data(words("12.5", "x1", "3e-4", "-")), blank=T.drop_blank(words("", " ", "x")))
    assert (r.short, r.single, r.data, r.blank) == (["bcde"], ["a", "5", "ab"], ["x1"], ["x"])
    r = values(spark, many=T.noun_heavy(words(*["NN"] * 15, "JJ")), few=T.noun_heavy(words(*["NN"] * 14, *["JJ"] * 14, "VB")), other=T.noun_heavy(words(*["NNS"] * 20)))
    assert (r.many, r.few, r.other) == (True, False, False)
    ok = "The cells of the heart were seen under a light source in all cases"
    r = values(spark, ok=T.passes_corpus_cuts(F.lit(ok)), digits=T.passes_corpus_cuts(F.lit(ok + " 1234567890 1234567890")), marks=T.passes_corpus_cuts(F.lit(ok + " ,,,,,,")), short=T.passes_corpus_cuts(F.lit(ok[:40])),
               tail=T.passes_corpus_cuts(F.lit(ok + " by Wang et al")), repeats=T.passes_corpus_cuts(F.lit(ok + " the the the")))
    assert tuple(r) == (True, False, False, False, False, False)


def test_titles_and_lines(spark):
    r = values(spark, title=T.is_section_title(F.lit("Methods"), F.lit("We did")), ended=T.is_section_title(F.lit("We did."), F.lit("Then")), low=T.is_section_title(F.lit("Methods"), F.lit("and so")), digit=T.is_section_title(F.lit("Methods"), F.lit("1 mg")),
               long=T.is_section_title(F.lit("one two three four five six seven eight"), F.lit("We")))
    assert tuple(r) == (True, False, False, True, False)
    rows = frame(spark, [("x" * 20,), ("x" * 21,)], "t string")
    assert sections.long_enough(rows, "t", 20).count() == 1


def test_character_functions(spark):
    r = values(spark, gone=T.remove_chars(F.lit("a-b_c"), "-_"), space=T.remove_chars(F.lit("a-b_c"), "-_", True), null=T.remove_null_chars(F.lit("a\0b")), nulls=T.remove_null_chars(F.lit("a\0b"), True),
               phrase=T.phrase_text(words("The", "Cell", "Wall")), nums=T.numbers_to_text(F.array(F.lit(1), F.lit(20))), cap=T.cap_first(F.lit("ab c")),
               inserted=T.insert_at(F.lit("ab\ncd"), F.lit("X"), F.lit(1), F.lit(1)), beyond=T.insert_at(F.lit("ab"), F.lit("X"), F.lit(5), F.lit(0)))
    assert tuple(r) == ("abc", "a b c", "ab", "a b", "the cell wall", "1 20", "Ab c", "ab\ncXd", "ab")


def test_number_of_a_noun(spark):
    nouns = {"men": False, "cells": False, "glass": True, "virus": True, "analysis": True, "cell wall": True, "heart cells": False, "Data": False}
    rows = frame(spark, [(n,) for n in nouns], "n string")
    assert {r.n: r.s for r in rows.select("n", determiners.is_singular(F.col("n")).alias("s")).collect()} == nouns
    sounds = {"hour": True, "European": False, "unit": False, "apple": True, "MRI": True, "UV": False, "NMR-based": True}
    rows = frame(spark, [(n,) for n in sounds], "n string")
    assert {r.n: r.s for r in rows.select("n", determiners.vowel_sound(F.col("n")).alias("s")).collect()} == sounds


# Joins, lookups, groups


def test_lookups(spark):
    index = frame(spark, [("J_of_X", 1), ("Y", 2)], "journal string, id int")
    assert [r.id for r in relational.by_journal(index, frame(spark, [("J of X",), ("Z",)], "journal string")).collect()] == [1]
    assert values(spark, v=vectors.by_positions(words("a", "b", "c"), F.array(F.lit(2), F.lit(0)))).v == ["c", "a"]
    groups = frame(spark, [(1, [5, 3]), (2, [3])], "group_id int, member_ids array<int>")
    members = frame(spark, [(3, "three"), (5, "five")], "id int, text string")
    assert {r.group_id: r.parts for r in vectors.look_up_members(groups, members).collect()} == {1: ["five", "three"], 2: ["three"]}
    matrix = frame(spark, [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0), ("not_embedded", "a", 0.1)], "i string, j string, sim double")
    got = {(r.p, r.q): r.sim for r in vectors.submatrix(matrix, ["a", "zz"], ["a", "b"]).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.5, (1, 0): 0.1, (1, 1): 0.0}
    numbered = relational.numbered(frame(spark, [("k", 5), ("k", 9), ("m", 1)], "k string, o int"), ["k"], "o")
    assert {(r.k, r.o, r.idx) for r in numbered.collect()} == {("k", 5, 1), ("k", 9, 2), ("m", 1, 1)}


def test_next_text_over_ranges(spark):
    """Ranges of the order join up, empty ones between them too, and null keys are a key."""
    rng = random.Random(1)
    rows = [(rng.choice(("a", None, "b")), i * rng.choice((1, 7)), f"t{i}") for i in range(60)]
    rows = list({(k, o): (k, o, t) for k, o, t in rows}.values())
    df = frame(spark, rows, "k string, o long, t string")
    want = {}
    for key in ("a", None, "b"):
        own = sorted((o, t) for k, o, t in rows if k == key)
        want |= {(key, o): n for (o, _), n in zip(own, [t for _, t in own[1:]] + ["None"])}
    for width in (5, 10_000):
        assert {(r.k, r.o): r.next for r in search.next_text(df, "o", "t", ("k",), width).collect()} == want
    assert [r.next for r in search.next_text(frame(spark, [(1, "x"), (2, "y")], "o long, t string"), "o", "t").orderBy("o").collect()] == ["y", "None"]


def test_pages_of_groups(spark):
    df = frame(spark, [("a", i) for i in range(5)] + [("b", 7)], "k string, v long")
    assert {(r.k, r.page): r["values"] for r in relational.collect_pages(df, "k", "v", 2).collect()} == {("a", 0): [0, 1], ("a", 1): [2, 3], ("a", 2): [4], ("b", 3): [7]}


def test_most_frequent(spark):
    r = values(spark, a=grams.most_frequent(words("b", "a", "b", "a", "c")), none=grams.most_frequent(F.array().cast("array<string>")))
    assert tuple(r.a) in ((2, "a"), ("a", 2)) and tuple(r.none) in ((0, ""), ("", 0))


def test_sections_of_articles(spark):
    xml = "<title>Methods</title>We took 5 cells. They grew.<title>Results</title>All died.<title>Discussion</title>"
    papers = frame(spark, [(1, xml), (2, None)], "doc_id int, nxml string")
    got = {(r.doc_id, r.section, r.sent_id): r.content for r in sections.article_groups(papers, 1).collect()}
    assert got[1, "Methods", 0] == "We took 5 cells." and got[1, "Results", 0] == "All died." and {k[0] for k in got} == {1}
    text = {r.doc_id: r.content for r in sections.section_text(papers, "Methods").collect()}
    assert text[2] == "" and "d_a_t_a" in text[1] and "cells" in text[1]


def test_section_titles_are_plain_lists():
    assert list(K.SECTION_TITLES) == ["Abstract", "Introduction", "Methods", "Results", "Discussion"]
    for starts, ends in K.SECTION_TITLES.values():
        assert all("(" not in t for t in starts + ends) and len(set(starts)) == len(starts) and len(set(ends)) == len(ends)
    assert K.SECTION_TITLES["Methods"][0][:4] == ("Method", "Method:", "Methods", "Methods:")
    assert sections.titles(("A", "B:")) == ["A", "B:", "a", "b:"]


def test_dates_and_names(spark):
    nxml = "<pub-date pub-type='x'><day>4</day><month>3</month><year>2019</year></pub-date><article-id pub-id-type=\"pmc\">77</article-id>"
    r = values(spark, a=records.article_date(F.lit(nxml)), s=records.summary_date(F.lit("2019 Mar")), w=records.one_word(F.lit("A  naïve title")), i=records.paper_id(F.lit(nxml)))
    assert (tuple(r.a), tuple(r.s), r.w, r.i) == (("2019", "3", "4"), ("2019", "Mar", "N/A"), "A_na_ve_title", "77")
    xml = ('<Author Valid="Y"><LastName>Doe</LastName><ForeName>Jo</ForeName><Initials>J</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author>'
           '<ArticleId IdType="doi">10.1/x</ArticleId>')
    r = values(spark, a=biblio.article_authors(F.lit(xml)), link=biblio.paper_link(F.lit(xml)), none=biblio.article_authors(F.lit("")))
    assert (r.a.authors, r.a.text, r.a.short, r.link, r.none.short) == (["Doe J", "The Group"], "Doe J, The Group.", "Doe J et al.", "https://doi.org/10.1/x", "")


def test_wordwise_columns(spark):
    df = frame(spark, [("A b", "C")], "x string, y string")
    assert tuple(corpus.wordwise_columns(df, ["x", "y"], F.lower).first()) == ("a b", "c")
    rows = corpus.curate(frame(spark, [("We are studying the cells",)], "sentence string"), subject=False, stop="small", stemmer="porter")
    assert rows.first().tokens == ["studi", "cell"]


# Search


@pytest.fixture(scope="module")
def groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = sections.sentence_groups(docs, 1).withColumn("id", F.col("doc_id") * 100_000 + F.col("sent_id"))
    return rows.select("id", "content", "number_of_words").cache()


def test_stored_index_scores_as_a_scan_does(spark, groups, tmp_path):
    path = f"file://{tmp_path}/index"
    search.write_index(groups, path, parts=8)
    for query in ("the thing that eran", "the", "zzzz", ""):
        for scoring in ("bm25", "const"):
            want = {r.id: r.score - 1 for r in search.search(groups, query, scoring=scoring, size=10_000, min_words=0).collect()}
            got = {r.id: r.score for r in search.index_scores(spark, path, query, scoring, parts=8).collect()}
            assert got == pytest.approx(want)
    assert want == {}
    fuzzy = {r.id: r.score - 1 for r in search.search(groups, "thign eran", fuzzy=True, size=10_000, min_words=0).collect()}
    assert {r.id: r.score for r in search.index_scores(spark, path, "thign eran", fuzzy=True, parts=8).collect()} == pytest.approx(fuzzy) and fuzzy
    plan = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(1) & F.col("term").isin("the"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters" in plan


def test_scores_by_plain_counts(groups):
    rows = {r.id: [w for w in re.split(r"[^\w]+", r.content.lower()) if w] for r in groups.collect()}
    asked = ["the", "of", "thing"]
    df = {t: sum(t in ws for ws in rows.values()) for t in asked}
    score = {i: sum(np.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] / (c[t] + 1.2) for t in asked) + 1 for i, ws in rows.items() if (c := Counter(ws)) and any(t in c for t in asked)}
    got = {r.id: r.score for r in search.search(groups, "the of thing the", size=10_000, min_words=0).collect()}
    assert got == pytest.approx(score)


def test_highlighted_words(spark):
    rows = queries()["highlighted"](spark, SF).collect()
    listed = {r.id: r.content for r in search.search(_all_groups(spark), "the thing that eran").collect()}
    mark = lambda s: "... " + re.sub(r"(?i)\b(eran|that|the|thing)\b", r"<em>\1</em>", s) + " ..."
    assert len(rows) == 120 and {r.id: r.shown for r in rows} == {i: mark(s) for i, s in listed.items()}


def test_highlighted_words_beside_other_letters(spark):
    """As the SQL has it, whose ``\\b`` knows ASCII letters only."""
    import duckdb

    texts = ["\u00e9the the_ 1the th\u00c9 \u00f1Thing\u2019s", "eran\u00df that\u4e2d the", "THE\u0301 the-thing", "the", ""]
    pattern = r"(?i)\b(eran|that|the|thing)\b"
    want = ["... " + duckdb.execute("SELECT regexp_replace(?, ?, '<em>\\1</em>', 'g')", [t, pattern]).fetchone()[0] + " ..." for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, s string").select("n", search.highlight(F.col("s"), ["the", "thing", "that", "eran"]).alias("shown"))
    assert [r.shown for r in rows.orderBy("n").collect()] == want


def _all_groups(spark):
    from inkwell.plans.searching import _groups

    return _groups(spark, SF)


def test_coverage_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(7)
    one, many = ({(r.query_id, r.doc_id): r.coverage for r in search.coverage_of(docs, asked, block=b).collect()} for b in (64, 3))
    assert one == many and len(one) == 140 and search.coverage_of(docs, asked.limit(0)).count() == 0


# Vectors and clusters


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


def test_approximate_neighbours_have_most_of_the_exact_ones(spark, rows):
    recall = defaultdict(list)
    centers = [c.tolist() for c in cluster.fit_kmeans(rows, 8).clusterCenters()]
    for r in rows.where("vec_id % 100 = 0").limit(4).collect():
        v = [float(x) for x in r.embedding]
        exact = {x.id for x in vectors.nearest_one(rows, v, 20).collect()}
        recall["lsh"].append(len(exact & {x.id for x in cluster.approximate_nearest(rows, v, 20).collect()}))
        recall["cells"].append(len(exact & {x.id for x in vectors.cell_search(rows, centers, v, 20, probes=7).collect()}))
    assert all(np.mean(n) >= 18 for n in recall.values()), recall


def test_small_world_graphs_have_nine_tenths(spark, rows, tmp_path):
    """Recall over blocks of a stored index, exact distances, and graphs of few rows."""
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    exact = {(r.query_id, r.id): r.distance for r in vectors.nearest(rows, asked, 10).collect()}
    for size in (4096, 100):
        path = f"file://{tmp_path}/graphs{size}"
        smallworld.build(rows, rows=size).write.parquet(path)
        index = spark.read.parquet(path)
        assert index.count() == max(1, -(-rows.count() * 5 // (size * 4)))
        found = {(r.query_id, r.id): r.distance for r in smallworld.search(index, asked, 10, block=7).collect()}
        both = exact.keys() & found.keys()
        assert len(found) == len(exact) and len(both) >= 0.9 * len(exact)
        assert all(found[x] == pytest.approx(exact[x], abs=1e-6) for x in both)
    few = smallworld.search(smallworld.build(rows.limit(3)), asked.limit(2), 10).collect()
    assert len(few) == 6 and smallworld.search(index, asked.limit(0), 3).count() == 0


def test_merged_batches_are_the_whole(rows):
    v = [float(x) for x in rows.first().embedding]
    parts = [vectors.nearest_one(rows.where(f"vec_id % 3 = {i}"), v, 15) for i in range(3)]
    assert vectors.merge_batches(parts, 15).collect() == vectors.nearest_one(rows, v, 15).collect()


def test_svd_and_pca(spark, rows):
    found = {r.vec_id: r.embedding for r in rows.collect()}
    ids = sorted(found)
    x = np.array([found[i] for i in ids], float)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    got, share = cluster.svd(rows, 8)
    got = {r.id: r.vec for r in got.collect()}
    assert np.allclose([got[i] for i in ids], (u * sign)[:, :8], atol=1e-6) and share == pytest.approx((s[:8] ** 2 / (s[:8] ** 2).sum()).tolist())
    assert cluster.svd(rows, 5000)[1] == []
    got, shares = cluster.pca(rows, 8)
    got = {r.vec_id: r.pc for r in got.collect()}
    w, v = np.linalg.eigh(np.cov(x.T))
    assert shares == pytest.approx((np.cumsum(w[::-1])[:8] / w.sum()).tolist())
    assert np.allclose(np.abs([got[i] for i in ids]), np.abs(x @ v[:, ::-1][:, :8]), atol=1e-6)


def test_random_projection(spark, rows):
    size = len(rows.first().embedding)
    m = vectors.projection_matrix(size, 16)
    assert set(np.unique(np.round(m, 9))) == {-round((3 / 16) ** 0.5, 9), 0.0, round((3 / 16) ** 0.5, 9)}
    got = {r.vec_id: r.embedding for r in vectors.random_projection(rows, 16).collect()}
    for r in rows.collect():
        assert np.allclose(got[r.vec_id], m @ np.array(r.embedding, float), atol=1e-9)
    assert vectors.random_projection(rows, size) is rows and vectors.min_dimension(1000, 0.5) == int(4 * np.log(1000) / (0.125 - 0.125 / 3))


def test_word_vectors_tell_words_apart(spark):
    texts = [(["red", "green", "blue"][i % 3:] + ["red", "green", "blue"][: i % 3] if i % 2 else ["dog", "cat", "cow"][i % 3:] + ["dog", "cat", "cow"][: i % 3],) for i in range(600)]
    vec = {r.word: np.array(r.vec) for r in cluster.train_words(frame(spark, texts, "tokens array<string>"), size=8, least=5).collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert set(vec) == {"red", "green", "blue", "dog", "cat", "cow"} and cos("red", "blue") > cos("red", "dog") and cos("cat", "cow") > cos("cat", "green")


def test_kmeans_is_a_fixed_point(rows):
    model = cluster.fit_kmeans(rows, 5)
    centers = np.array([c for c in model.clusterCenters()])
    for r in cluster.predict(model, rows).collect():
        assert r.cluster == ((centers - np.array(r.embedding, float)) ** 2).sum(1).argmin()
    assert cluster.fit_kmeans(rows.limit(3), 50).getK() == 3


def test_medoids(spark, rows):
    got = {r.label: r.center for r in cluster.cosine_medoids(rows).collect()}
    by = defaultdict(list)
    for r in rows.collect():
        v = np.array(r.embedding, float)
        by[r.label].append((r.vec_id, v / np.linalg.norm(v)))
    for label, found in by.items():
        u = np.array([v for _, v in found])
        sums = np.round((u @ u.T).sum(1), 6)
        assert got[label] == min(i for (i, _), s in zip(found, sums) if s == sums.max())


def test_layers_divide_every_row(spark, rows):
    out = cluster.layerwise_division(rows, 3, 2).collect()
    n = rows.count()
    assert Counter(r.layer for r in out) == {0: n, 1: n, 2: n}
    paths = defaultdict(dict)
    for r in out:
        paths[r.id][r.layer] = r.path
    assert all(p[0] == "0" and p[2].startswith(p[1] + ".") and p[1].startswith("0.") for p in paths.values())
    members = defaultdict(set)
    for r in out:
        members[r.path].add(r.id)
    assert all(r.center in members[r.path] for r in out)


def test_agglomerative_against_plain_merging(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3))
    rows = frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    parts = [{i} for i in range(12)]
    while len(parts) > 3:
        d = {(a, b): np.mean([np.linalg.norm(x[i] - x[j]) for i in parts[a] for j in parts[b]]) for a in range(len(parts)) for b in range(a)}
        a, b = min(d, key=d.get)
        parts[b] |= parts.pop(a)
    got = defaultdict(set)
    for r in cluster.agglomerative(rows, 3).collect():
        got[r.cluster].add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts))


def test_mini_batches(spark, tmp_path):
    centers, weights = cluster.update_centers([[0.0], [10.0]], [1.0, 1.0], frame(spark, [([1.0],), ([3.0],), ([10.0],)], "embedding array<double>"))
    assert centers == [[pytest.approx(4 / 3)], [10.0]] and weights == [3.0, 2.0]
    centers, weights = cluster.update_centers([[0.0], [500.0]], [50.0, 0.0], frame(spark, [([1.0],), ([2.0],)], "embedding array<double>"), reassign=0.05)
    assert centers[1] in ([1.0], [2.0]) and weights == [52.0, 52.0]
    src, at = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    batches = [[[0.0], [2.0]], [[4.0], [9.0]], [[11.0]]]
    stream = lambda: incremental.file_stream(spark, src, "embedding array<double>", files_per_batch=1)
    want, w = [[1.0], [10.0]], [0.0, 0.0]
    for i, b in enumerate(batches):
        df = frame(spark, [(v,) for v in b], "embedding array<double>").coalesce(1)
        df.write.mode("append").parquet(src)
        got = incremental.fit_centers(stream(), [[1.0], [10.0]], f"{at}/check", f"{at}/centres", reassign=0.0)
        want, w = cluster.update_centers(want, w, df)
        assert got == want
    assert incremental.fit_centers(stream(), [[7.0], [8.0]], f"{at}/check", f"{at}/centres", reassign=0.0) == want


def test_spelling_with_any_letter_wrong(spark):
    known = ["happy", "cat", "letter", "a", "abc", "banana"]
    rng, asked = random.Random(3), ["hapy", "jappy", "at", "xletter", "eltter", "b", "zzzzzz", "bnana", "appyh"]
    asked += ["".join(rng.choice("abct") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    vocabulary = frame(spark, [(w, i + 1) for i, w in enumerate(known)], "term string, df int")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    got = {r.word: r.corrected for r in vectors.spell_corrected(frame(spark, [(w,) for w in asked], "word string"), vocabulary).collect()}
    for w in asked:
        near = [(i, -distance(w, k), k) for i, k in enumerate(known) if distance(w, k) <= 2]
        assert got[w] == (max(near)[2] if near else w), w


def test_segments_and_database(spark):
    rows = frame(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "doc_id int, sent_id int, content string")
    got = {(r.doc_id, tuple(r.member_ids)): r.segment for r in vectors.segment_groups(rows, 2).collect()}
    assert got == {(1, (0, 1)): "a. b.", (1, (1, 2)): "b. c."}
    lut = vectors.parse_lut(frame(spark, [("cat 1 0.5",), ("dog -1 2 ",)], "value string"))
    assert {r.word: r.vec for r in lut.collect()} == {"cat": [1.0, 0.5], "dog": [-1.0, 2.0]}
    db = frame(spark, [(["a", "b"],), (["b"],), (["c"],)], "tokens array<string>")
    ranked = vectors.compare_to_database(db, lambda t: F.size(F.array_intersect(t, words("a", "b"))).cast("double"))
    assert [r.sim for r in ranked.collect()] == [2.0, 1.0, 0.0]
    assert values(spark, s=vectors.second_largest(F.array(F.lit(3.0), F.lit(9.0), F.lit(9.0)))).s == 9.0
    unit = values(spark, c=vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).c
    assert unit == pytest.approx(0.5 ** 0.5)


# Graphs


def test_reach_has_no_limit_of_rounds(spark):
    edges = frame(spark, [(i, i + 1) for i in range(104)] + [(500, 501)], "src long, dst long")
    seeds = frame(spark, [(0,)], "id long")
    assert {r.id for r in graph.expand_to(edges, seeds).collect()} == set(range(105))
    assert graph.expand_to(edges, seeds, size=5).count() == 5


# Tags and phrases


def test_sub_matrices_and_modes(spark):
    phrases = F.array(words("the", "cell"), words("a", "wall"))
    r = values(spark, fpo=chunk.phrase_modes(phrases, "fpo"), cp=chunk.phrase_modes(phrases, "cp"), asp=chunk.phrase_modes(phrases, "asp"))
    assert (r.fpo, r.cp, r.asp) == ([["the", "cell"]], [["the", "cell", "a", "wall"]], [["the", "cell"], ["a", "wall"]])
    with pytest.raises(ValueError):
        chunk.phrase_modes(phrases, "x")


def plain_spans(tags, items):
    """Backtracking with recursion: the first way to match from each place, in order of preference."""
    def match(i, k):
        if k == len(items):
            return i
        regex, least, many, greedy = items[k]
        reach = 0
        while i + reach < len(tags) and regex.fullmatch(tags[i + reach]) and (many or reach < 1):
            reach += 1
        steps = range(reach, least - 1, -1) if greedy else range(least, reach + 1)
        return next((e for n in steps if (e := match(i + n, k + 1)) is not None), None)

    out, i = [], 0
    while i < len(tags):
        e = match(i, 0)
        if e is not None and e > i:
            out.append((i, e))
            i = e
        else:
            i += 1
    return out


def test_spans_against_backtracking():
    rng = random.Random(2)
    for grammar in (*[chunk.GRAMMARS[k] for k in ("NP", "VP", "relation_VP")], *chunk.OLD_GRAMMARS.values(), "<NN.*>*?<JJ>", "<A>", "<DT>?<NN>*<NN><VB>+?"):
        items = chunk.compile_grammar(grammar)
        for _ in range(60):
            tags = [rng.choice(["NN", "NNS", "JJ", "VB", "VBD", "IN", "DT", "RB", "MD", "TO", "A"]) for _ in range(rng.randint(0, 14))]
            assert chunk.chunk_spans(tags, items) == plain_spans(tags, items)


def test_chunk_query_against_plain_version(spark):
    """Tags, chunks, cut adjectives and joined neighbours of every sentence, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r.doc_id, r.pos): (r.n_np, r.n_vp) for r in queries()["chunk_np_vp"](spark, SF).collect()}
    items = {k: chunk.compile_grammar(chunk.GRAMMARS[k]) for k in ("NP", "VP")}
    n = 0
    for d in docs:
        for pos, s in enumerate(x.strip() for x in (d.text or "").split(".")):
            if d.doc_id % 7:
                continue
            tags = chunk.rule_tagger(chunk.tokenize(s))
            want = []
            for k in ("NP", "VP"):
                spans = plain_spans(tags, items[k])
                want.append(sum(not i or spans[i - 1][1] != a for i, (a, _) in enumerate(spans)))
            assert got[d.doc_id, pos] == tuple(want)
            n += 1
    assert n > 100


def test_extract_and_subjects(spark):
    tagged = "the/DT big/JJ cat/NN often/RB eats/VBZ red/JJ fish/NN and/CC sleeps/VBZ"
    df = frame(spark, [(1, tagged), (2, ""), (3, None)], "i int, s string").withColumn("w", chunk.parse_tags(F.col("s")))
    texts = lambda c: F.transform(c, lambda p: F.array_join(F.transform(p, lambda w: w["word"]), " "))
    got = {r.i: r for r in df.select("i", texts(chunk.extract(chunk.chunk(F.col("w"), "NP"), "NP")).alias("np"), texts(chunk.extract(chunk.chunk(F.col("w"), "VP"), "VP")).alias("vp"),
                                     F.array_join(chunk.remove_subject(chunk.chunk(F.col("w"), "SV")), " ").alias("told")).collect()}
    assert got[1].np == ["the big cat often", "eats red fish and"] and got[2].np == [] and got[3].np is None
    assert got[1].vp[0].startswith("often eats") and got[1].told.startswith(K.SUBJECT_MARK)
    runs = df.where("i = 1").select(chunk.noun_verb_runs(F.col("w")).alias("r")).first().r
    assert runs == ["cat", "eats", "fish"]
    all_ = frame(spark, [("A cat eats",)], "s string").select(chunk.tag_all(F.col("s"), {"rule": chunk.rule_tagger, "nouns": lambda ws: ["NN"] * len(ws)}).alias("t")).first().t
    assert [w.tag for w in all_.rule] == ["DT", "NN", "NNS"] and [w.tag for w in all_.nouns] == ["NN"] * 3


def test_patterns_as_written():
    """A noun phrase is a chain of up to eight links with conjunctions and prepositions between them."""
    link = r"<PDT>?<DT>?<PRP\$>?<CD>?<VB.*>*?<DT>?<PRP\$>?<CD>?<RB>*<JJ.*>*<NN.*>*"
    first = r"<PDT>?<DT>?<PRP\$>?<CD>?<VB.*>*?<DT>?<PRP\$>?<CD>?<RB>*<JJ.*>*<NN.*>+"
    pair = link + "<CC>?" + link
    rest = "<IN>?" + pair + "<IN>?" + pair + "<IN>?" + pair
    np_, vp = first + "<CC>?" + link + rest, "<MD>*<RB.*>*<VB.*>+<JJ.*>*<VB.*>*<NN.*>*<IN>*<TO>?"
    assert chunk.GRAMMARS == {"NP": np_, "VP": vp, "relation_VP": vp + "<RB.*>*<JJ.*>*", "SV": np_ + vp, "SV_O": np_ + vp + pair + rest, "SVO": np_ + vp + np_}


def test_section_titles_as_written():
    intro = ("Introduction", "Introduction:", "Introductions", "Background", "Background:", "Backgrounds", "Backgrounds:")
    assert K.SECTION_TITLES["Abstract"] == (("Abstract", "Abstract:"), intro) and K.SECTION_TITLES["Introduction"][0] == intro


def test_spans_as_texts_of_tags():
    """Tags matched as texts give the spans of the item-by-item matcher, whatever the grammar and however many tags."""
    rng = np.random.default_rng(5)
    for names in (["DT", "JJ", "NN", "NNS", "IN", "CC", "VB", "VBD", "VBG", "RB", "MD", "TO", "PRP$", "CD", ".", "PDT"], [f"NN{i}" for i in range(40)] + [f"VB{i}" for i in range(40)], ["DT", "."]):
        sizes = rng.integers(0, 30, 60)
        tags = [names[i] for i in rng.integers(0, len(names), sizes.sum())]
        for grammar in [*chunk.GRAMMARS.values(), *chunk.OLD_GRAMMARS.values(), "<DT>*<NN.*>*?", "<JJ>*?<NN.*>"]:
            items, known = chunk.compile_grammar(grammar), sorted(set(tags))
            want = chunk._spans(np.array([known.index(x) for x in tags]), known, sizes, items)
            assert [tuple(x) for x in chunk._matches(pa.array(tags, pa.string()), sizes, items).tolist()] == want


def test_phrases_counted_in_one_pass(spark):
    """The counts are the sizes of the phrases taken out step by step, and words and tags don't leave Python for them."""
    rng = np.random.default_rng(6)
    some = ["the", "a", "cat", "cats", "quickly", "of", "and", "is", "running", "famous", "42", ",", "Rome", "its", "can", "both"]
    rows = [(i, " ".join(some[j] for j in rng.integers(0, len(some), n))) for i, n in enumerate(rng.integers(0, 25, 200))] + [(200, None), (201, "")]
    df = frame(spark, rows, "i int, s string")
    steps = [F.size(chunk.extract(chunk.chunk(chunk.tag(F.col("s")), x), x, join_neighbours=True)) for x in chunk.GRAMMARS]
    want = {r.i: r.n for r in df.where("s IS NOT NULL").select("i", F.array(*steps).alias("n")).collect()}
    got = {r.i: r.n for r in df.select("i", chunk.count_phrases(F.col("s"), tuple(chunk.GRAMMARS)).alias("n")).collect()}
    assert got.pop(200) is None and got == want
    plan = queries()["chunk_np_vp"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "<word" not in plan and "word:string" not in plan and plan.count("ArrowEvalPython") == 1


def test_noun_parts_in_one_pass(spark):
    """Parts told in one pass are those divided step by step, and the query moves no words with tags."""
    rng = np.random.default_rng(7)
    some = ["the", "a", "an", "cat", "cats", "of", "and", "is", "famous", "hour", "its", "this", "by", "old", "both", "."]
    rows = [(i, " ".join(some[j] for j in rng.integers(0, len(some), n))) for i, n in enumerate(rng.integers(0, 25, 300))] + [(300, None), (301, "")]
    df = frame(spark, rows, "i int, s string")
    phrases = F.transform(F.filter(chunk.chunk(chunk.tag(F.col("s")), "NP"), lambda x: x["label"] == "NP"), lambda x: chunk.divide_noun_phrase(x["leaves"]))
    parts = df.select("i", F.flatten(phrases).alias("p")).select("i", "p", F.transform("p", chunk.noun_of).alias("nouns")).collect()
    got = {r.i: r.p for r in df.select("i", chunk.noun_parts(F.col("s")).alias("p")).collect()}
    for r in parts:
        if r.p is None:
            assert got[r.i] is None
            continue
        assert [x.noun for x in got[r.i]] == r.nouns
        for x, p in zip(got[r.i], r.p):
            at = [k for k, w in enumerate(p[:-1]) if w.tag in ("DT", "PRP$")]
            assert x.alone == (len(p) == 1 and p[0].tag == "DT")
            assert (x.det, x.following) == ((p[at[0]].word, p[at[0] + 1].word) if at else (None, None))
    assert "word:string" not in queries()["determiner_suggest"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sentence_groups_squeeze_once(spark):
    """Sentences squeezed with the whole text are those squeezed one by one, whatever white space, blank lines and periods; and
    a group's words are not squeezed again for each size."""
    rng = random.Random(9)
    some = ["a", "et", "al.", "et al.", "b.", ".", "..", " ", "  ", "\n", "\n\n", " \n \t\n", "\u00a0", "\u2003", "\u0085", "\u2028", "\r\n", "caf\u00e9", "\x0b"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 20))) for _ in range(400)] + ["", "\n", " . ", "et\nal.", "et\n\nal.", "et \nal.", None]
    df = frame(spark, list(enumerate(texts)), "i int, text string")
    both = df.select("i", F.transform(sections.section_sentences(F.col("text")), T.squeeze).alias("want"), sections.squeezed_sentences(F.col("text")).alias("got")).collect()
    assert [(r.i, r.got) for r in both] == [(r.i, r.want) for r in both]
    groups = sections.groups_of_sizes(df, (1, 2, 3), keep=("i",))
    want = [sorted(map(tuple, sections.sentence_groups(df, n, keep=("i",)).collect())) for n in (1, 2, 3)]
    assert [sorted(map(tuple, groups.where(f"num_group = {n}").collect())) for n in (1, 2, 3)] == want
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_gram_features_in_place(spark):
    """Only grams of the vocabulary move: counts are those of every gram made and looked up, also for repeated ids."""
    rng = random.Random(11)
    rows = [(i % 50 if i % 7 else None, " ".join(rng.choice(["a", "b", "cell", "The", "x1", "wall,"]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(1, None), (2, "")]
    vocab = [(1, "cell"), (1, "none"), (2, "a b"), (2, "cell cell"), (2, "wall the"), (2, "too many words"), (3, "a b cell"), (3, "a b a"), (3, "the x the")]
    want = Counter()
    for i, t in rows:
        bag = re.sub(r"\W", " ", re.sub(r"\d", "", t or "")).lower().split()
        want.update((i, n, " ".join(bag[k:k + n])) for n in (1, 2, 3) for k in range(len(bag) - n + 1) if (n, " ".join(bag[k:k + n])) in vocab)
    found = stats.gram_features(frame(spark, rows, "doc_id int, text string"), frame(spark, vocab, "n int, gram string"))
    got = {(r.id, r.n, r.gram): r.weight for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - np.log2(c + 1)) < 1e-9 for k, c in want.items())
    assert stats.gram_features(frame(spark, rows, "doc_id int, text string"), frame(spark, [], "n int, gram string")).count() == 0
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_embedded_texts_count_words_in_place(spark):
    """Sums of word vectors by brute force, of few and of many numbers, also for repeated ids; counts are not shuffled, and
    short vectors are summed as columns."""
    rng = random.Random(12)
    rows = [(i % 30, " ".join(rng.choice(["a", "B", "b", "cell\u00a0c", "\n", "unknown", "\u00c9t\u00e9"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(30, None), (31, " \n")]
    for size in (3, 70):
        vec = {w: [rng.uniform(-1, 1) for _ in range(size)] for w in ("a", "b", "c", "cell", "\u00e9t\u00e9")}
        weight = {"a": 1.0, "b": 2.0, "c": 0.0, "cell": 0.5, "\u00e9t\u00e9": 3.0}
        docs = frame(spark, rows, "doc_id long, text string")
        found = vectors.embed_texts(docs, frame(spark, list(vec.items()), "word string, vec array<double>"), frame(spark, list(weight.items()), "word string, weight double"), unit_words=False, unit=False, size=size)
        want = defaultdict(lambda: np.zeros(size))
        for i, text in rows:
            for w in (text or "").lower().split():
                want[i] += weight.get(w, 0) * np.array(vec.get(w, np.zeros(size)))
        got = found.collect()
        assert len(got) == len(rows) and all(np.allclose(r.vec, want[r.id]) for r in got)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("Aggregate [") == 1 and ("aggregate_metrics" not in plan.lower() and "summary" not in plan.lower() or size > 64)


def test_noun_phrases_are_chains_that_are_divided(spark):
    said = ["the effect of the drug and the dose", "dose can go"]
    df = frame(spark, [(1, i, s) for i, s in enumerate(said)], "doc_id int, pos int, sentence string")
    texts = df.select("pos", chunk.extract(chunk.chunk(chunk.tag(F.col("sentence")), "NP"), "NP").alias("p")).where("pos = 0").first().p
    assert [" ".join(w.word for w in p) for p in texts] == [said[0]]
    got = [(r.pos, r.part, r.noun, r.suggestion) for r in determiners.suggest(df).orderBy("pos", "part").collect()]
    assert got == [(0, 0, "effect", None), (0, 1, "drug", None), (0, 2, "dose", None), (1, 0, "dose", "this"), (1, 1, "go", None)]


def test_merged_counts_keep_texts_without_a_language(spark, tmp_path):
    frame(spark, [(1, "aaaa bbbb", "en"), (2, "aaaa cccc", None), (3, "aaaa", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.gram: r.cnt for r in queries()["gram_merge_partials"](spark, str(tmp_path)).where("n = 1").collect()}
    assert got == {"aaaa": 3, "bbbb": 1, "cccc": 1}


def test_determiners_by_plain_memory(spark):
    """The last sentence's nouns get this or these, earlier ones the, new ones nothing."""
    said = ["A cat can go", "cat can go", "dogs can go", "cat can go", "fish can go and dogs can go", "dogs can go"]
    got = {(r.pos, r.noun): r.suggestion for r in determiners.suggest(frame(spark, [(1, i, s) for i, s in enumerate(said)] + [(2, 0, "cat can go")], "doc_id int, pos int, sentence string")).where("doc_id = 1").collect()}
    assert got == {(0, "cat"): None, (0, "go"): None, (1, "cat"): "this", (1, "go"): "this", (2, "dogs"): None, (2, "go"): "this", (3, "cat"): "the", (3, "go"): "this",
                   (4, "fish"): None, (4, "dogs"): "the", (4, "go"): "this", (5, "dogs"): "these", (5, "go"): "this"}


def test_stems_of_the_documents(spark):
    """Porter's rule by rule examples, on both kinds."""
    from inkwell.functions import stem

    porter = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop",
              "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
              "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
              "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: stem.porter(w) for w in porter} == porter
    snowball = {"consign": "consign", "consigned": "consign", "consistency": "consist", "knaves": "knave", "kneeling": "kneel", "generously": "generous", "dying": "die", "skies": "sky", "news": "news", "happy": "happi", "ties": "tie", "cries": "cri"}
    assert {w: stem.porter2(w) for w in snowball} == snowball
    rows = queries()["stem_words"](spark, SF).collect()
    assert all((r.porter, r.snowball) == (stem.porter(r.w), stem.porter2(r.w)) for r in rows)


def test_separated_words(spark):
    from inkwell.functions import stem

    costs = stem.word_costs(["the", "heart", "cell", "cells", "a"])
    df = frame(spark, [("theheart cells, the-cell zzq",), (None,)], "s string")
    assert [r.t for r in df.select(stem.separate(costs, 10, F.col("s")).alias("t")).collect()] == ["the heart cells, the-cell zzq", None]


def test_vocabulary_document(spark):
    """The document's parts are the counts and continuations of its kept grams."""
    r = queries()["vocabulary_document"](spark, SF).first()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {n: {x.gram: x.cnt for x in grams.keep_top(grams.count_grams(docs, orders=(n,)), {n: 500}).collect()} for n in (1, 2, 3)}
    assert r.subject == "all" and (r.unigram_freq, r.bigram_freq, r.trigram_freq) == (kept[1], kept[2], kept[3])
    for n, listed in ((2, r.bigram_dict), (3, r.trigram_dict)):
        want = defaultdict(list)
        for gram, cnt in sorted(kept[n].items(), key=lambda x: (-x[1], x[0])):
            want[gram.rsplit(" ", 1)[0]].append((gram, gram.rsplit(" ", 1)[1], cnt))
        assert {k: [tuple(e) for e in v] for k, v in listed.items()} == want


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = f"file://{tmp_path}/events"
    events.write.parquet(src)
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): (r.n, round(r.total or 0, 6)) for r in spark.table("windows").collect()}
    want = {(r.start, r.event_type): (r.n, round(r.total or 0, 6)) for r in events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert got == pytest.approx(want) if not got else {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-4) for k in want)


def test_statistics_of_two_counts(spark):
    r = values(spark, n=stats.idf_tokens(F.lit("A bb, CCC é éé")))
    assert r.n == ["bb", "ccc", "éé"]
