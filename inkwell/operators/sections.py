"""Sections, sentences and overlapping sentence groups of articles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def titles(names) -> list[str]:
    """Titles, then all of them in lower case."""
    return [*names, *(x.lower() for x in names)]


def _last(s: Column, pattern: str) -> Column:
    """Group 1 of the last match, or null."""
    found = F.regexp_extract_all(s, F.lit("(?d)" + pattern), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def extract_section(s: Column, section: str) -> Column:
    """A section's content, '' if there is none.

    For each start title in order: between it and the first end title as title elements, else an element named by the
    start title, else between it and further end titles. The last match counts; the first success ends the search.
    """
    starts, ends = (titles(x) for x in K.SECTION_TITLES[section])
    any_of = lambda names: "|".join(re.escape(x) for x in sorted(set(names), key=len, reverse=True))
    literals = lambda names: F.array(*map(F.lit, names))

    def patterns(x, a):
        """What to look for with a start title, in order, of titles that the article has. Titles are plain words."""
        both = lambda b: F.array_contains(x["titles"], a) & F.array_contains(x["titles"], b)
        between = lambda names: F.transform(F.filter(literals(names), both), lambda b: F.concat(F.lit("(?d)<title>"), a, F.lit("</title>(.*?)<title>"), b, F.lit("</title>")))
        own = F.filter(F.array(a), lambda t: F.array_contains(x["elements"], t))
        return F.concat(between(ends[:1]), F.transform(own, lambda t: F.concat(F.lit("(?d)<"), t, F.lit(">(.*?)</"), t, F.lit(">"))), between(ends[1:]))

    def find(x):
        tries = F.flatten(F.transform(literals(starts), lambda a: patterns(x, a)))
        found = F.transform(tries, lambda p: F.try_element_at(F.regexp_extract_all(x["text"], p, F.lit(1)), F.lit(-1)))
        return F.coalesce(F.try_element_at(F.filter(found, lambda r: r.isNotNull()), F.lit(1)), F.lit(""))

    text = F.coalesce(s, F.lit(""))
    titled = F.regexp_extract_all(text, F.lit(f"<title>({any_of(starts + ends)})</title>"), F.lit(1))
    own = F.regexp_extract_all(text, F.lit(f"<({any_of(starts)})>"), F.lit(1))
    return F.transform(F.array(F.struct(text.alias("text"), titled.alias("titles"), own.alias("elements"))), find)[0]


def plain_section(lines: DataFrame, section: str, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines between a start title and an end title, by document, only where an end title was found.

    A title is a line that ends in it. ``lines`` has one row for each line with its position.
    """
    starts, ends = (titles(x) for x in K.SECTION_TITLES[section])
    tail = lambda names: F.rtrim(F.col(line)).rlike("(" + "|".join(re.escape(x) for x in names) + ")$")
    marks = lines.groupBy(doc).agg(F.min(F.when(tail(starts), F.col(pos))).alias("__a"))
    ended = lines.join(marks, doc).where((F.col(pos) > F.col("__a")) & tail(ends)).groupBy(doc, "__a").agg(F.min(pos).alias("__b"))
    return lines.join(ended, doc).where((F.col(pos) > F.col("__a")) & (F.col(pos) < F.col("__b"))).drop("__a", "__b")


def section_sentences(s: Column) -> Column:
    """Non-empty lines joined by spaces, et al. joined, split at periods, trimmed. The last piece may be ''."""
    joined = F.array_join(T.drop_blank(F.split(s, "\n")), " ")
    return T.sentences(T.join_et_al(joined))


def squeezed_sentences(s: Column) -> Column:
    """``section_sentences``, each squeezed: white space is squeezed in the whole text, line ends and blank lines first, since
    et al. may go over one."""
    joined = F.replace(F.regexp_replace(s, r"(?U)\n(?:[^\S\n]*\n)*", " "), F.lit("et al."), F.lit("et_al"))
    return F.transform(F.split(F.regexp_replace(joined, r"(?U)\s+", " "), "[.]"), lambda x: F.trim(x))


def sentence_groups(df: DataFrame, n: int, text_col: str = "text", keep=("doc_id",), final_period: bool = True) -> DataFrame:
    """One row for each group of n neighbouring sentences: kept columns, sent_id, content, number_of_words, num_group.

    Sentences of a group are joined by '. ' with white space squeezed; empty groups go but keep their number.
    """
    split = df.select(*keep, section_sentences(F.col(text_col)).alias("__s"))
    texts = F.transform(T.group_of(F.col("__s"), n), lambda g: T.squeeze(F.array_join(g, ". ")))
    if final_period:
        texts = F.transform(texts, lambda c: F.when((c == "") | F.endswith(c, F.lit(".")), c).otherwise(F.concat(c, F.lit("."))))
    rows = split.select(*keep, F.posexplode(texts).alias("sent_id", "content")).where("content <> ''")  # made once, before any condition on it
    return rows.select(*keep, "sent_id", "content", T.count_squeezed(F.col("content")).alias("number_of_words"), F.lit(n).alias("num_group"))


def groups_of_sizes(df: DataFrame, sizes, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``sentence_groups`` of several sizes in one pass: a text is split once, and its groups stay side by side."""
    split = df.select(*keep, squeezed_sentences(F.col(text_col)).alias("__s"))  # before they are joined: once, whatever the sizes
    told = lambda c: F.when((c == "") | F.endswith(c, F.lit(".")), c).otherwise(F.concat(c, F.lit(".")))
    texts = lambda n: F.col("__s") if n == 1 else F.transform(T.group_of(F.col("__s"), n), lambda g: F.trim(F.array_join(g, ". ")))
    some = lambda n: F.transform(texts(n), lambda c, i: F.struct(i.alias("sent_id"), told(c).alias("content"), F.lit(n).alias("num_group")))
    rows = split.select(*keep, F.explode(F.concat(*map(some, sizes))).alias("__g")).select(*keep, "__g.*").where("content <> ''")
    return rows.select(*keep, "sent_id", "content", T.count_squeezed(F.col("content")).alias("number_of_words"), "num_group")


def article_groups(articles: DataFrame, n: int, xml_col: str = "nxml", keep=("doc_id",), sections=tuple(K.SECTION_TITLES)) -> DataFrame:
    """Sentence groups of every section of every article. A missing article has none."""
    one = articles.select(*keep, F.explode(F.array(*[F.struct(F.lit(s).alias("section"), T.clean_lightly(extract_section(F.col(xml_col), s), False).alias("__text")) for s in sections])).alias("x"))
    return sentence_groups(one.select(*keep, "x.section", "x.__text"), n, "__text", (*keep, "section"))


def section_text(articles: DataFrame, section: str, xml_col: str = "nxml", keep=("doc_id",)) -> DataFrame:
    """A section in search form; '' where the article or the section is missing."""
    found = extract_section(F.col(xml_col), section)
    return articles.select(*keep, F.when(found == "", F.lit("")).otherwise(T.clean_for_search(found, "section")).alias("content"))


def combine_paragraphs(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """(doc, text): lines of a document joined; section titles on lines of their own; a broken word loses its hyphen."""
    following = F.coalesce(F.lead(line).over(Window.partitionBy(doc).orderBy(pos)), F.lit(""))
    own = F.col(line)
    told = F.when(T.is_section_title(own, following), F.concat(F.lit("\n"), own, F.lit("\n"))).otherwise(F.regexp_replace(own, "-$", ""))
    rows = lines.select(doc, F.struct(pos, told.alias("t")).alias("x"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))


def until_references(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", sentence: str = "sentence") -> DataFrame:
    """Sentences before the first that begins with References."""
    cut = F.min(F.when(F.startswith(F.col(sentence), F.lit("References")), F.col(pos))).over(Window.partitionBy(doc))
    return rows.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col(pos) < F.col("__cut"))).drop("__cut")


def long_enough(df: DataFrame, col: str, least: int) -> DataFrame:
    """Paragraphs (20) or sentences (5) of more characters than that."""
    return df.where(F.length(col) > least)
