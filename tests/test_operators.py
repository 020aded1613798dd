import math
import uuid

import pytest
from pyspark.sql import functions as F


from inkwell.operators import biblio, chunk, cluster, determiners, graph, grams, markov, records, relational, search, sections, stats, vectors
from inkwell.sources import readers, writers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pmi(spark):
    docs = [["aqq", "bqq"]] * 2 + [["bqq", "aqq"]] * 2 + [["cqq", "dqq"]] * 3 + [["aqq", "cqq"]]
    df = frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.i, r.j): r.pmi for r in stats.pmi(stats.cooccurrence(stats.term_counts(df), 8)).collect()}
    assert got["aqq", "bqq"] == pytest.approx(0.678, abs=1e-3)


def test_markov(spark):
    df = frame(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a")], "k int, o int, s string")
    counts = markov.transition_counts(df, "k", "s", "o")
    assert {(r.prev, r.cur): r.cnt for r in counts.collect()} == {("<START>", "a"): 2, ("a", "b"): 1, ("a", "a"): 1, ("b", "<END>"): 1, ("a", "<END>"): 1}
    assert all(abs(r.t - 1) < 1e-12 for r in markov.normalized(counts).groupBy("prev").agg(F.sum("p").alias("t")).collect())
    arrays = frame(spark, [(["a", "b"],), ([],), (["a", "a"],)], "s array<string>")
    assert sorted(markov.array_transitions(arrays, "s").collect()) == sorted(counts.collect())


def test_merge_counts(spark):
    a, b, c = (frame(spark, [(1, str(k), v) for k, v in m.items()], "n int, gram string, cnt long") for m in ({1: 2, 2: 1, 5: 2}, {1: 2, 2: 2, 3: 2}, {2: 1, 4: 1, 6: -1}))
    assert {r.gram: r.cnt for r in grams.merge_counts(a, b, c).collect()} == {"1": 4, "2": 4, "3": 2, "4": 1, "5": 2}


@pytest.mark.parametrize(("ids", "n", "want"), [([1, 2, 3, 5, 6, 9], 2, [1, 3, 5, 9]), ([4, 1], 3, [1, 4]), ([], 2, []), ([1, 2], 1, [1, 2])])
def test_greedy_gaps(spark, ids, n, want):
    got = frame(spark, [(ids,)], "x array<int>").select(search.without_gaps(F.col("x"), n)).first()[0]
    assert got == want and all(b - a > n - 1 for a, b in zip(got, got[1:]))


def test_neighbours_and_sentinel(spark):
    df = frame(spark, [(1, 0, "a"), (1, 1, "b"), (1, 3, "d")], "doc_id int, sent_id int, content string")
    assert {(r.sent_id, r.prev, r.next) for r in search.neighbours(df).collect()} == {(0, "", "b"), (1, "a", ""), (3, "", "")}
    assert search.or_sentinel(df.limit(0)).first()[0] == -1 and search.or_sentinel(df).count() == 3


def test_mix_score(spark):
    r = spark.range(1).select(search.mix_score(F.lit(2.0), F.lit(1), F.lit(0.25)).alias("a"), search.mix_score(F.lit(2.0), F.lit(0), F.lit(0.25)).alias("b")).first()
    assert r.a == 1.0 and r.b == float("-inf")


def test_upsert(spark, tmp_path):
    df = frame(spark, [(1, "x"), (2, "y"), (3, "x")], "seq int, content string")
    got = {r.content: (r.id, r.seq) for r in writers.upserted(df, "seq").collect()}
    assert got == {c: (str(uuid.uuid5(uuid.NAMESPACE_DNS, c)), s) for c, s in (("x", 3), ("y", 2))}
    path = f"file://{tmp_path}/t"
    writers.upsert_table(spark, path, df, "content", "seq")
    out = writers.upsert_table(spark, path, frame(spark, [(9, "x"), (4, "z")], "seq int, content string"), "content", "seq")
    assert {(r.content, r.seq) for r in spark.read.parquet(out).collect()} == {("x", 9), ("y", 2), ("z", 4)}


def test_sections(spark):
    xml = "<title>Introduction</title>old<title>Methods</title>m1<title>Introduction</title>new<title>Methods</title>m2<title>Results</title>r<title>Discussion</title>"
    get = lambda x, s: spark.createDataFrame([(x,)], "x string").select(sections.extract_section(F.col("x"), s)).first()[0]
    assert get(xml, "Introduction") == "new" and get(xml, "Results") == "r" and get(xml, "Discussion") == "" and get(None, "Methods") == ""
    assert get("<abstract>short</abstract>", "Abstract") == "short"
    lines = frame(spark, [(1, i, t) for i, t in enumerate(["x", "Introduction", "a", "b", "Methods", "c"])] + [(2, 0, "Introduction"), (2, 1, "z")], "doc_id int, pos int, line string")
    assert sorted((r.doc_id, r.line) for r in sections.plain_section(lines, "Introduction").collect()) == [(1, "a"), (1, "b")]
    groups = sections.sentence_groups(frame(spark, [(1, "One. Two.\n\nThree et al. said.")], "doc_id int, text string"), 2).collect()
    assert [(r.sent_id, r.content) for r in groups] == [(0, "One. Two."), (1, "Two. Three et_al said."), (2, "Three et_al said.")]
    told = sections.combine_paragraphs(frame(spark, [(1, 0, "Intro"), (1, 1, "Start of a bro-"), (1, 2, "ken word.")], "doc_id int, pos int, line string")).first().text
    assert told == "\nIntro\nStart of a broken word."


def test_records(spark):
    art = ('<PubmedArticle><ArticleId IdType="pubmed">7</ArticleId><Title>J</Title><ISOAbbreviation>J.</ISOAbbreviation><ArticleTitle>A <i>b</i></ArticleTitle><Abstract>T\n</Abstract>'
           "<DateX><Year>1999</Year></DateX><PubDate><Year>2001</Year><Month>May</Month></PubDate></PubmedArticle>")
    rows = records.split_articles(frame(spark, [(art + art.replace("<i>b</i>", "c"),)], "xml string"))
    links = frame(spark, [("<LinkSet><IdList><Id>7</Id></IdList><LinkSetDb><LinkName>cites</LinkName><Link><Id>8</Id></Link><Link><Id>9</Id></Link></LinkSetDb></LinkSet>",)], "xml string")
    r = records.parse_articles(rows, records.link_counts(links)).first()
    assert (r.pmid, r.title, r.num_cited, r.year, r.month, r.day) == ("7", "A c", 3, "1999", "May", "N/A")
    assert records.parse_articles(rows, records.link_counts(links, strict=True), strict=True).first().year == "2001"
    assert {(e.src, e.dst, e.link_type) for e in records.link_edges(links).collect()} == {("7", "8", "cites"), ("7", "9", "cites")}
    got = spark.range(1).select(*[records.project_mode(F.lit("A title"), F.lit("It is 5. Ok"), m).alias(m) for m in ("ft", "db", "svo", "for_display")]).first()
    assert got.for_display == "A title\nIt is 5. Ok" and got.db == "A title. It is 5. Ok." and "." not in got.ft and got.svo.endswith(".")


def test_references(spark):
    df = frame(spark, [(1, "Results", "as [&b&] and [&a&]"), (1, "Introduction", "see [&c&], [&a&]")], "doc_id int, section string, text string")
    numbers = biblio.number_references(biblio.reference_uses(df))
    assert {r.ref: r.idx for r in numbers.collect()} == {"c": 1, "a": 2, "b": 3}
    assert {r.section: r.text for r in biblio.substitute_references(df, numbers).collect()} == {"Results": "as [3] and [2]", "Introduction": "see [1], [2]"}
    assert spark.range(1).select(biblio.split_numbers(F.lit("a [1] b [2]"))).first()[0] == ["a ", "[1]", " b ", "[2]"]


def test_endnote(spark):
    text = 'head\n\nDoe, J (2001) "On things." Journal of X 12(3): 45-67.\nAn abstract'
    r = biblio.endnote(frame(spark, [(1, text)], "rec int, text string")).first()
    assert (r.title, r.author, r.year, r.journal, r.abstract) == ("On things", "Doe, J.", "2001", "Journal of X 2001;12(3):45-67.", "An abstract")


def test_vectors(spark):
    df = frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [6.0, 8.0])], "vec_id long, embedding array<double>")
    r = {x.vec_id: (x.u, x.c) for x in df.select("vec_id", vectors.normalized(F.col("embedding")).alias("u"), vectors.cosine(F.col("embedding"), F.array(F.lit(3.0), F.lit(4.0))).alias("c")).collect()}
    assert r[1] == ([0.6, 0.8], 1.0) and r[2] == ([0.0, 0.0], 0.0) and r[3][1] == pytest.approx(1)
    q = df.where("vec_id <> 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert [(x.query_id, x.id, x.distance) for x in vectors.nearest(df, q, 2, block=1).orderBy("query_id", "rank").collect()] == [(1, 1, 0.0), (1, 2, 25.0), (3, 3, 0.0), (3, 1, 25.0)]
    lut = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vec array<double>")
    w = frame(spark, [("a", 1.0), ("b", 1.0)], "word string, weight double")
    got = {x.id: x.vec for x in vectors.embed_texts(frame(spark, [(1, "a A b"), (2, ""), (3, "zzz")], "doc_id long, text string"), lut, w).collect()}
    assert got[1] == pytest.approx([2 / 5 ** 0.5, 1 / 5 ** 0.5]) and got[2] == got[3] == [0.0, 0.0]
    corrected = vectors.spell_corrected(frame(spark, [("hapy",), ("zq",)], "word string"), frame(spark, [("happy", 5), ("hippy", 1)], "term string, df int"))
    assert {x.word: x.corrected for x in corrected.collect()} == {"hapy": "happy", "zq": "zq"}


def test_word_alignment(spark):
    m = frame(spark, [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "i string, j string, sim double")
    assert vectors.sentence_similarity(m, ["a"], ["b"]) == pytest.approx(0.5)
    assert vectors.sentence_similarity(m, ["a"], ["a", "b"]) == pytest.approx(1.0) and vectors.sentence_similarity(m, [], ["a"]) == 1.0


def test_clusters(spark):
    rows = [(i, [x]) for i, x in enumerate((1.0, 1.0, 1.2, 55.0, 1.1, 1.5, 49.0, 47.0))]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    for found in (cluster.predict(cluster.fit_kmeans(df, 2), df), cluster.agglomerative(df, 2).withColumnRenamed("id", "vec_id")):
        by = {}
        for r in found.collect():
            by.setdefault(r.cluster, set()).add(r.vec_id)
        assert sorted(map(sorted, by.values())) == [[0, 1, 2, 4, 5], [3, 6, 7]]
    tree = cluster.layerwise_division(df, 2, 2).collect()
    assert len(tree) == 16 and {r.layer for r in tree} == {0, 1}


def test_chunks(spark):
    df = frame(spark, [("CREB/NN expression/NN has/VBZ been/VBN shown/VBN to/TO be/VB new/JJ in/IN brain/NN",)], "s string").select(chunk.parse_tags(F.col("s")).alias("w"))
    df = df.select("w", chunk.chunk(F.col("w"), "VP").alias("vp"), chunk.chunk(F.col("w"), "SV").alias("sv"))
    vp = [" ".join(w.word for w in p) for p in df.select(chunk.extract(F.col("vp"), "VP")).first()[0]]
    assert vp == ["has been shown to", "be new"] or vp == ["has been shown to", "be new in"] or vp[0] == "has been shown to"
    assert df.select(chunk.remove_subject(F.col("sv"))).first()[0][0] == "S_U_B_J_E_C_T"
    spans = chunk.chunk_spans(["NN"] * 300 + ["DT"] + ["NN"] * 300, chunk.compile_grammar(chunk.GRAMMARS["SVO"]))
    assert spans == []
    with pytest.raises(ValueError):
        chunk.compile_grammar("(<NN>)+")


def test_spans_are_those_of_a_backtracking_matcher():
    import random
    import re

    rng = random.Random(1)
    for _ in range(200):
        tags = [rng.choice(("NN", "NNS", "JJ", "DT", "VB", "IN", "MD")) for _ in range(rng.randint(0, 9))]
        for label in ("NP", "VP", "SV"):
            pattern = re.sub(r"<([^>]*)>", lambda m: "(?:<" + m[1].replace(".", "[^<>]") + ">)", chunk.GRAMMARS[label])
            line = "".join(f"<{t}>" for t in tags)
            want = [(line[:m.start()].count("<"), line[:m.end()].count("<")) for m in re.finditer(pattern, line) if m.end() > m.start()]
            assert chunk.chunk_spans(tags, chunk.compile_grammar(chunk.GRAMMARS[label])) == want


def test_determiners(spark):
    df = frame(spark, [(1, 0, "the man is very happy"), (1, 1, "man is a apple"), (1, 2, "man is an car")], "doc_id int, pos int, sentence string")
    got = {(r.pos, r.noun): r.suggestion for r in determiners.suggest(df).collect()}
    assert got[1, "man"] == "this" and got[1, "apple"] == "an" and got[2, "car"] == "a" and got[0, "man"] is None


def test_graph(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("x", "y")], "src string, dst string")
    ids = lambda df: {r.id for r in df.collect()}
    seed = frame(spark, [("a",)], "id string")
    assert ids(graph.neighbours(edges, seed)) == {"b"} and ids(graph.expand(edges, seed, 2)) == {"a", "c"} and ids(graph.expand_to(edges, seed)) == {"a", "b", "c", "d"}
    assert {r.id: r.n for r in graph.in_degree(edges).collect()} == {"b": 1, "c": 2, "y": 1}


def test_sets(spark):
    a, b = frame(spark, [(x,) for x in (1, 2, 3, 4, 5, 10, 9, 11, 22, 21, 1)], "x int"), frame(spark, [(x,) for x in (5, 6, 9, 1, 0, 2)], "x int")
    assert sorted(r.x for r in relational.multiset_common(a, b).collect()) == [1, 2, 5, 9]
    assert relational.subset(b.where("x = 9"), a) and not relational.subset(b, a) and relational.subset(a.limit(0), b)
    assert {r.key: r.total for r in relational.sum_by_key(frame(spark, [("p",), ("q",)], "key string"), frame(spark, [("p", 1), ("p", 2)], "key string, value int")).collect()} == {"p": 3, "q": 0}
    assert {(r.first, r.last) for r in relational.islands(frame(spark, [(1, 1), (1, 2), (1, 4)], "k int, p int"), ["k"], "p").collect()} == {(1, 2), (4, 4)}


def test_readers(spark, tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    for name, text in {"PMC1.nxml": "one", "deep/PMC2_0.nxml": "two", "deep/PMC2_1.nxml": "three", "deep/PMC2_3.nxml": "lost"}.items():
        (d / name).write_text(text)
    assert {r.pmcid: r.nxml for r in readers.articles(spark, f"file://{d}").collect()} == {"PMC1": "one", "PMC2": "two \nthree \n"}
    (tmp_path / "lic.csv").write_text("h1,h2,h3,h4,h5,h6\nf1,J,PMC1,d,11,CC\nf2,J,PMC1,d,12,CC\n")
    assert [(r.pmcid, r.file_loc) for r in readers.licences(spark, f"file://{tmp_path}/lic.csv").collect()] == [("1", "f2")]
    (tmp_path / "info.txt").write_text("1 A_title J_of_X J. 2001 May 4 7\nbad line\n")
    assert readers.paper_info(spark, f"file://{tmp_path}/info.txt").first().title == "A title" and readers.bad_paper_info(spark, f"file://{tmp_path}/info.txt").count() == 1
    (tmp_path / "pairs.txt").write_text("t1\na1\nt2\na2")
    assert [(r.title, r.abstract) for r in readers.line_pairs(spark, f"file://{tmp_path}/pairs.txt").orderBy("idx").collect()] == [("t1", "a1"), ("t2", "a2")]
    rows = spark.range(10).select(F.col("id").alias("seg_id"))
    writers.write_shards(rows, f"file://{tmp_path}/store", size=4)
    assert sorted(r.seg_id for r in readers.shards(spark, f"file://{tmp_path}/store", 3, 9, 4).collect()) == list(range(3, 9))


def test_autocomplete(spark):
    counts = grams.count_grams(frame(spark, [(1, "the fish eats fishing boats and fishing nets")], "doc_id int, text string"))
    ranked = grams.autocomplete_rank(counts, "fish", "the")
    assert {r.gram: r.score for r in ranked.collect()} == {"fish": 16, "fishing": 2}
    assert [r.phrase for r in grams.autocomplete_chain(counts, ranked).orderBy("pos").collect()][:3] == ["fish", "fishing", "fish eats"]


def test_grams_of_all_orders_are_counted_in_one_pass(spark, monkeypatch):
    """F19, F20, F22 to F24, F27, F28: each order read and cut the texts again, and the best of each was sorted by itself."""
    from collections import Counter

    texts = ["the fish eats fishing boats and fishing nets", "", None, "one", "nets and boats and boats and nets", "<b>Fish</b> 12 eats; the fish eats"] * 3
    monkeypatch.setattr(grams, "CHARS", 60)
    want = Counter()
    for t in texts:
        w = [] if t is None else t.lower().replace("<b>", " ").replace("</b>", " ").replace("12", "").replace(";", " ").split()
        want.update((n, " ".join(w[i:i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1) if n > 1 or len(w[i]) >= 4)
    docs = frame(spark, [(t,) for t in texts], "text string").repartition(2)
    assert {(r.n, r.gram): r.cnt for r in grams.count_grams(docs).collect()} == want
    top = grams.top_grams(docs, top={1: 2, 2: 3, 3: 4})
    best = lambda n, k: sorted(((-c, g) for (m, g), c in want.items() if m == n))[:k]
    assert sorted((r.n, -r.cnt, r.gram) for r in top.collect()) == [(n, *x) for n, k in ((1, 2), (2, 3), (3, 4)) for x in best(n, k)]
    assert top._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_tfidf_moves_texts_once(spark):
    """counts moved by (id, term), and weights twice by id. Texts of one id still count as one."""
    docs = frame(spark, [(1, "aa bb aa"), (2, "bb cc"), (1, "aa cc"), (3, ""), (4, None)], "doc_id int, text string")
    rows = stats.tfidf(docs)
    got = {(r.id, r.term): r.weight for r in rows.collect()}
    idf = lambda df: math.log(6 / (1 + df)) + 1
    raw = {(1, "aa"): 3 * idf(1), (1, "bb"): idf(2), (1, "cc"): idf(2), (2, "bb"): idf(2), (2, "cc"): idf(2)}
    assert got == pytest.approx({k: w / math.sqrt(sum(v * v for (i, _), v in raw.items() if i == k[0])) for k, w in raw.items()})
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
