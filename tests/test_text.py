import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import constants as K
from inkwell.functions import stem
from inkwell.functions import text as T


def one(spark, value, f, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(("word", "want"), [(w, True) for w in ("45e", "452", "0.77", "2e-20", "4e20", "-99", "75%", "10", "100", "5", "3", "", "e")] + [(w, False) for w in ("ge", "ewwe", "ddd", "g")])
def test_is_data(spark, word, want):
    assert one(spark, word, T.is_data) is want


@pytest.mark.parametrize(("f", "value", "want"), [
    (T.mask_section_index, "2.2.2. this is good", "section_index this is good"), (T.join_et_al, " by Doe et al. and", "by Doe et_al and"), (T.decode_entities, "&amp;lt;a&gt;", "<a>"),
    (T.squeeze, " a \n\t b c ", "a b c"), (T.fix_period, "a.b..c", "a. b. . c"), (lambda s: T.fix_period(s, True), "a.b..c", "a. b. c"), (T.remove_tags, " <p>a</p> ", "a"),
    (T.tags_to_spaces, "<p>a</p>", " a "), (T.dash_escapes, "1&#x02013;2", "1-2"), (T.remove_references, "a<ref-list x>b</ref-list>c", "a c"), (T.repair_line_wrap, "exam- ple a -b", "example ab"),
    (T.cap_first, "abc", "Abc"), (T.or_na, "  ", "N/A"), (T.or_na, None, "N/A"), (T.as_boolean, "TRUE", True), (T.as_boolean, None, False), (T.underscored, "a b", "a_b"),
    (T.clean_query, "The figure 5.5 shows A_B!", "the f_i_g_u_r_e d_a_t_a d_a_t_a shows a_b"), (T.clean_segment, " a, b-c. ", "a b c"),
    (lambda s: T.clean_for_search(s, "section"), "See Fig.2 by Doe et al. with 0.77 of it.", "see f_i_g_u_r_e d_a_t_a by doe et al with d_a_t_a d_a_t_a of it."),
    (lambda s: T.most_repeats(T.words(s)), "a b a c a", 3), (T.digit_share, "  ", 1.0), (T.mark_share, "a.b", 1 / 3), (T.starts_with_vowel, "alpha-x", True), (T.starts_with_vowel, "MRI", True), (T.starts_with_vowel, "great", False),
])
def test_functions(spark, f, value, want):
    got = one(spark, value, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(("f", "value", "want"), [
    (lambda w: T.subwords(w, 3, whole=True), "happy", ["hap", "app", "ppy", "happy"]), (lambda w: T.left_edges(w, 3), "quick", ["qui", "quic", "quick"]), (lambda w: T.subwords(w, 9), "happy", ["happy"]),
    (lambda s: T.grams(T.words(s), 2), "a b c", ["a b", "b c"]), (lambda s: T.grams(T.words(s), 4), "a b c", []), (T.sentences, "a. b.", ["a", "b", ""]), (T.plain_tokens, "<b>A</b>, b\nc", ["A", "b", "c"]),
    (T.corpus_tokens, "The Wang is 5 figs fig.1 him 1a", ["be", "D_A_T_A", "figs", "F_I_G_U_R_E", "P_R_O_N_O_U_N"]),
])
def test_arrays(spark, f, value, want):
    assert one(spark, value, f) == want


def test_group_of_counts(spark):
    for size in range(6):
        for n in range(1, 5):
            got = spark.createDataFrame([([str(i) for i in range(size)],)], "s array<string>").select(T.group_of(F.col("s"), n)).first()[0]
            assert len(got) == max(0, size - n + 1)


@pytest.mark.parametrize(("q", "s", "want"), [(["a", "b"], ["b"], 0.5), ([], ["b"], 1.0), (["a"], [], 0.0)])
def test_coverage(spark, q, s, want):
    assert spark.createDataFrame([(q, s)], "q array<string>, s array<string>").select(T.coverage(F.col("q"), F.col("s"))).first()[0] == want


def test_edit_distance_and_insert(spark):
    r = spark.createDataFrame([("a b", "abc", "l0\nl1", 1, 1)], "a string, b string, s string, l int, p int").select(
        T.edit_distance(F.col("a"), F.col("b")), T.insert_at(F.col("s"), F.lit("+"), F.col("l"), F.col("p"))).first()
    assert r[0] == pytest.approx(1 / 3) and r[1] == "l0\nl+1"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("generalization", "gener"), ("controll", "control"), ("sky", "sky"), ("probate", "probat"), ("adjustment", "adjust")])
def test_porter(word, want):
    assert stem.porter(word) == want


@pytest.mark.parametrize(("word", "want"), [("consignment", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("knots", "knot"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("happily", "happili"), ("kneeled", "kneel"), ("conspirator", "conspir"), ("news", "news"), ("gas", "gas"), ("gaps", "gap"), ("cries", "cri"), ("ties", "tie")])
def test_porter2(word, want):
    assert stem.porter2(word) == want


def test_word_separation(spark):
    costs = stem.word_costs(["is", "a", "friend", "of", "mine", "and", "he", "likes", "for", "instance", "fish"])
    assert one(spark, "is afriend ofmine, and he", lambda s: stem.separate(costs, 10, s)) == "is a friend of mine, and he"


def test_cleaning_agrees_with_python(spark):
    """Cleaned text has none of what it removes, and cleaning twice changes nothing more."""
    rows = [("a<b>c</b> 1.5 &amp; é fig. 2",), ("",), ("x" * 5000 + ". end",)]
    df = spark.createDataFrame(rows, "s string").select(T.clean_segment(F.col("s")).alias("s"))
    again = df.select(T.clean_segment(F.col("s")).alias("s"))
    for (a,), (b,) in zip(df.collect(), again.collect()):
        assert a == b and not re.search(r"[^a-zA-Z0-9_. ]", a)


def test_constants():
    assert len(K.PRONOUNS) == 31 and len(K.FIGURE_IDS) == 54 and "-" not in K.MARKS["without_junction"] and "_" not in K.MARKS["without_connection"]


def test_shares_and_repeats_of_long_texts_take_linear_time(spark):
    """a class of all but marks took 0.7 us a character, and repeats were counted word by word against all."""
    import time

    long = spark.range(8, numPartitions=4).select(F.concat(F.repeat(F.lit("plain words, 1 "), 100_000), F.col("id").cast("string")).alias("s"))
    many = spark.range(4, numPartitions=4).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("w"), (i % 29_999).cast("string"))).alias("t"))
    for rows, f, want in ((long, T.mark_share(F.col("s")), 1 / 12), (long, T.digit_share(F.col("s")), 1 / 12), (many, T.most_repeats(F.col("t")), 2)):
        start = time.monotonic()
        assert {round(r[0], 4) for r in rows.select(f).collect()} == {round(want, 4)}
        assert time.monotonic() - start < 3
    assert one(spark, None, T.most_repeats, "s array<string>") == one(spark, [None], T.most_repeats, "s array<string>") == 0
