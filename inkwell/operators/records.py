"""Records out of article and link XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_or_na(s: Column, pattern: str) -> Column:
    """First match of group 1 without tags, 'N/A' if there is none. An empty match stays empty."""
    found = F.regexp_extract_all(s, F.lit("(?d)" + pattern), F.lit(1))
    return F.when(F.size(found) == 0, F.lit("N/A")).otherwise(T.remove_tags(F.try_element_at(found, F.lit(1))))


def element(s: Column, tag: str) -> Column:
    return first_or_na(s, f"(<{tag}(?:\\s[^>]*)?>.*?</{tag}>)")


def split_articles(df: DataFrame, col: str = "xml", tag: str = "PubmedArticle") -> DataFrame:
    """(pmid, article): the articles of a response; of equal ids the last counts."""
    bare = F.replace(F.col(col), F.lit("\n"), F.lit(""))
    parts = F.regexp_extract_all(bare, F.lit(f"(?d)<{tag}>(.*?)</{tag}>"), F.lit(1))
    rows = df.select(F.monotonically_increasing_id().alias("__f"), F.posexplode(parts).alias("__p", "article"))
    rows = rows.withColumn("pmid", first_or_na(F.col("article"), r'<ArticleId IdType="pubmed">(.*?)</ArticleId>'))
    return rows.groupBy("pmid").agg(F.max_by("article", F.struct("__f", "__p")).alias("article"))


def pubmed_date(s: Column, strict: bool = False) -> Column:
    """(year, month, day), 'N/A' where missing. Looked for in the whole article if it has a publication date; ``strict``
    looks inside that date only."""
    where = F.regexp_extract(s, "(?d)<PubDate>(.*?)</PubDate>", 1) if strict else s
    has = F.contains(s, F.lit("PubDate"))
    part = lambda tag: F.when(has, element(where, tag)).otherwise(F.lit("N/A"))
    return F.struct(part("Year").alias("year"), part("Month").alias("month"), part("Day").alias("day"))


def summary_date(s: Column) -> Column:
    """'2019 Mar 4' as (year, month, day), 'N/A' where missing."""
    w = T.words(s)
    return F.struct(*[F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("N/A")).alias(n) for i, n in enumerate(("year", "month", "day"), 1)])


def article_date(s: Column) -> Column:
    """Date of an article file: the first pub-date's parts."""
    d = F.regexp_extract(s, "(?d)<pub-date[^>]*>(.*?)</pub-date>", 1)
    return F.struct(*[first_or_na(d, f"<{n}>(.*?)</{n}>").alias(n) for n in ("year", "month", "day")])


def one_word(s: Column) -> Column:
    """Titles and journals for the record file: non-ASCII to spaces, squeezed, spaces to underscores."""
    return T.underscored(T.squeeze(T.non_ascii_to_spaces(s)))


def link_counts(df: DataFrame, col: str = "xml", strict: bool = False) -> DataFrame:
    """(pmid, num_cited) of each link set. The set's own id is among those counted unless ``strict``."""
    sets = df.select(F.explode(F.regexp_extract_all(F.replace(F.col(col), F.lit("\n"), F.lit("")), F.lit("(?d)<LinkSet>(.*?)</LinkSet>"), F.lit(1))).alias("s"))
    own = F.regexp_extract(F.regexp_extract("s", "(?d)<IdList>(.*?)</IdList>", 1), "(?d)<Id>(.*?)</Id>", 1)
    n = F.size(F.regexp_extract_all("s", F.lit("(?d)<Id>(.*?)</Id>"), F.lit(1)))
    return sets.select(own.alias("pmid"), (n - 1 if strict else n).alias("num_cited"))


def link_edges(df: DataFrame, col: str = "xml") -> DataFrame:
    """(src, dst, link_type): all linked ids by type."""
    bare = F.replace(F.col(col), F.lit("\n"), F.lit(""))
    sets = df.select(F.explode(F.regexp_extract_all(bare, F.lit("(?d)<LinkSet>(.*?)</LinkSet>"), F.lit(1))).alias("s"))
    sets = sets.select(F.regexp_extract(F.regexp_extract("s", "(?d)<IdList>(.*?)</IdList>", 1), "(?d)<Id>(.*?)</Id>", 1).alias("src"),
                       F.explode(F.regexp_extract_all("s", F.lit("(?d)<LinkSetDb>(.*?)</LinkSetDb>"), F.lit(1))).alias("d"))
    return sets.select("src", F.explode(F.regexp_extract_all("d", F.lit("(?d)<Id>(.*?)</Id>"), F.lit(1))).alias("dst"), F.regexp_extract("d", "(?d)<LinkName>(.*?)</LinkName>", 1).alias("link_type"))


def parse_articles(articles: DataFrame, counts: DataFrame, strict: bool = False) -> DataFrame:
    """Nine-field records of articles that have a citation count."""
    a = F.col("article")
    date = pubmed_date(a, strict)
    rows = articles.select("pmid", element(a, "Title").alias("journal"), element(a, "ISOAbbreviation").alias("journal_abbrev"),
                           element(a, "ArticleTitle").alias("title"), element(a, "Abstract").alias("abstract"), date.alias("d"))
    return rows.join(counts, "pmid").select("pmid", "journal", "journal_abbrev", "num_cited", "title", "abstract", "d.year", "d.month", "d.day")


def paper_id(s: Column) -> Column:
    return F.regexp_extract(s, '(?d)<article-id pub-id-type="pmc">(.*?)</article-id>', 1)


def project_mode(title: Column, abstract: Column, mode: str) -> Column:
    """A record's text: ``for_display`` raw, ``db`` cleaned lightly, ``svo`` and ``ft`` in search form, the last without periods."""
    if mode == "for_display":
        return F.concat_ws("\n", title, abstract)
    both = F.concat(title, F.lit(". "), abstract)
    if mode == "db":
        return T.clean_lightly(both)
    out = T.clean_for_search(both, "abstract")
    if mode == "svo":
        return out
    if mode != "ft":
        raise ValueError("mode is ft, db, svo or for_display")
    return T.squeeze(F.replace(out, F.lit("."), F.lit("")))
