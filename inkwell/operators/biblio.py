"""Bibliographic text: BibTeX, ENW, RIS and EndNote records, citation strings, reference numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s\s+", " "))


def citation(authors: Column, title: Column, journal: Column) -> Column:
    return collapse(F.concat(authors, F.lit(" "), title, F.lit(" "), journal))


def short_citation(authors: Column, year: Column, title: Column) -> Column:
    """Seven characters of the authors, the year, ten characters of the title."""
    return collapse(F.concat(F.substring(authors, 1, 7), F.lit(", "), year, F.lit(", "), F.substring(title, 1, 10)))


def journal_text(abbrev: Column, year: Column, volume: Column, issue: Column, page: Column) -> Column:
    """'abbrev year;volume(issue):page.', the last three only where present."""
    part = lambda c, a, b: F.when(F.length(c) > 0, F.concat(F.lit(a), c, F.lit(b))).otherwise(F.lit(""))
    return F.trim(F.concat(abbrev, F.lit(" "), year, F.lit(";"), part(volume, "", ""), part(issue, "(", ")"), part(page, ":", ".")))


def bibtex(s: Column) -> Column:
    """A BibTeX entry as a record. Of the places, booktitle goes before journal before series."""
    flat = F.regexp_replace(F.trim(s), "\n", "")
    get = lambda name: F.regexp_extract(flat, rf"(?d){name}\s*=\s*\{{(.*?)\}},", 1)
    author, book, journal, series, year, pages, url, location = (get(n) for n in ("author", "booktitle", "journal", "series", "year", "pages", "url", "location"))
    title = F.regexp_extract(flat, r"(?d)(?:,|\s)title\s*=\s*\{(.*?)\},", 1)
    place = F.when(F.length(book) > 0, book).when(F.length(journal) > 0, journal).otherwise(series)
    told = F.concat(place, F.lit(", "), pages, F.lit(", "), location, F.lit(", "), year)
    dot = lambda c: F.concat(c, F.lit("."))
    return F.struct(citation(dot(author), dot(title), told).alias("citation"), short_citation(author, year, title).alias("citation_short"), title.alias("title"),
                    author.alias("author"), F.when(F.length(journal) > 0, journal).otherwise(book).alias("journal"), url.alias("link"))


def tagged_fields(df: DataFrame, kind: str, id_col: str = "rec", text_col: str = "text") -> DataFrame:
    """(rec, pos, field, priority, value): the lines of ENW or RIS records."""
    keys = K.RIS_KEYS if kind == "ris" else {k: (v, 0) for k, v in K.ENW_KEYS.items()}
    shape = r"^(\w\w)\s*-\s?(.*)$" if kind == "ris" else r"^(%.)\s(.*)$"
    line = F.trim("line")
    known = F.create_map(*[x for k, (f, p) in keys.items() for x in (F.lit(k), F.struct(F.lit(f).alias("field"), F.lit(p).alias("priority")))])
    rows = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.select(id_col, "pos", F.try_element_at(known, F.regexp_extract(line, shape, 1)).alias("k"), F.trim(F.regexp_extract(line, shape, 2)).alias("value"))
    return rows.where("k is not null").select(id_col, "pos", "k.field", "k.priority", "value")


def best_fields(fields: DataFrame, id_col: str = "rec") -> DataFrame:
    """(rec, field, values): of a field's keys only those of the highest priority, values in order."""
    top = F.max("priority").over(Window.partitionBy(id_col, "field"))
    rows = fields.withColumn("__top", top).where("priority = __top")
    return rows.groupBy(id_col, "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def tagged_records(df: DataFrame, kind: str, id_col: str = "rec", text_col: str = "text") -> DataFrame:
    """Citations of ENW or RIS records; several values are joined by ', '."""
    best = best_fields(tagged_fields(df, kind, id_col, text_col), id_col)
    wide = best.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("field", F.array_join("values", ", ")))).alias("m"))
    get = lambda name: F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(""))
    page = get("page") if kind == "enw" else F.when(F.length(get("end_page")) > 0, F.concat(get("start_page"), F.lit("-"), get("end_page"))).otherwise(get("start_page"))
    abbrev = F.when(F.length(get("abbrev")) > 0, get("abbrev")).otherwise(get("journal"))
    told = journal_text(abbrev, get("year"), get("volume"), get("issue"), page)
    dot = lambda c: F.concat(c, F.lit("."))
    return wide.select(id_col, citation(dot(get("author")), dot(get("title")), told).alias("citation"), short_citation(get("author"), get("year"), get("title")).alias("citation_short"),
                       get("title").alias("title"), get("author").alias("author"), get("journal").alias("journal"), F.lit("").alias("link"))


def endnote(df: DataFrame, id_col: str = "rec", text_col: str = "text") -> DataFrame:
    """Records of an EndNote export: blocks between empty lines after the first, the citation in a block's first line."""
    blocks = df.select(id_col, F.posexplode(F.split(F.trim(text_col), "\n\n")).alias("block", "b")).where("block > 0")
    line = F.trim(F.element_at(F.split("b", "\n"), 1))
    title = F.regexp_extract(line, r'(?d)"(.*?)"', 1)
    author = F.trim(F.regexp_extract(line, r"(?d)^(.*?)\((?:19|20)[0-9]{2}\)", 1))
    place = F.trim(F.substr(F.regexp_extract(line, r'(?d)("\s(?:.*?):(?:.*?)\.)', 1), F.lit(2)))
    name = F.trim(F.regexp_replace(F.element_at(F.split(place, ":"), 1), r"\d+(\(\d+\))", ""))
    year = F.regexp_extract(line, r"(?d)^.*?\(((?:19|20)[0-9]{2})\)", 1)
    volume, issue, page = F.regexp_extract(place, r"(\d+)\(", 1), F.regexp_extract(place, r"\((\d+)\)", 1), F.regexp_extract(place, r"(\d+-\d+)", 1)
    rest = F.trim(F.array_join(F.slice(F.split("b", "\n"), 2, 1 << 20), "\n"))
    return blocks.select(id_col, "block", F.substr(title, F.lit(1), F.length(title) - 1).alias("title"), rest.alias("abstract"),
                         F.when(F.endswith(author, F.lit(".")), author).otherwise(F.concat(author, F.lit("."))).alias("author"),
                         journal_text(name, year, volume, issue, page).alias("journal"), year.alias("year"), line.alias("citation"))


def placeholders(s: Column) -> Column:
    """Contents of [&...&] in order."""
    return F.regexp_extract_all(s, F.lit(r"(?d)\[&(.*?)&\]"), F.lit(1))


def reference_uses(sections: DataFrame, section: str = "section", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, section, rank, pos, ref): placeholders of a document's sections, in the fixed order of sections."""
    rank = F.array_position(F.array(*map(F.lit, K.SECTION_ORDER)), F.col(section)).cast("int")
    return sections.select(doc, section, rank.alias("rank"), F.posexplode(placeholders(F.col(text))).alias("pos", "ref")).where("rank > 0")


def number_references(uses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ref, idx): references from 1 by first appearance. Also renumbers after a reference is deleted."""
    first = uses.groupBy(doc, "ref").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select(doc, "ref", F.row_number().over(Window.partitionBy(doc).orderBy("at")).alias("idx"))


def count_references(uses: DataFrame, doc: str = "doc_id", section: str = "section") -> DataFrame:
    """(doc, section, ref, times): citations of each reference in each section."""
    return uses.groupBy(doc, section, "ref").agg(F.count("*").alias("times"))


def substitute_references(sections: DataFrame, numbers: DataFrame, section: str = "section", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Sections with [&ref&] replaced by [index]."""
    listed = numbers.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("ref", "idx"))).alias("__m"))
    swap = F.reduce(placeholders(F.col(text)), F.col(text), lambda s, r: F.replace(s, F.concat(F.lit("[&"), r, F.lit("&]")), F.concat(F.lit("["), F.try_element_at("__m", r).cast("string"), F.lit("]"))))
    return sections.join(listed, doc, "left").select(doc, section, F.coalesce(swap, F.col(text)).alias("text"))


def split_numbers(s: Column) -> Column:
    """Text and [n] marks, each a piece of its own."""
    return F.filter(F.split(F.regexp_replace(s, r"(\[\d+\])", "\0$1\0"), "\0"), lambda x: x != "")


def paper_link(s: Column) -> Column:
    """DOI out of an article's id list as a link."""
    return F.concat(F.lit("https://doi.org/"), F.regexp_extract(s, r'(?d)<ArticleId IdType="doi">(.*?)</ArticleId>', 1))


def article_authors(s: Column) -> Column:
    """Authors as 'Last Initials', collective names whole; the short form is the first with et al. if there are more."""
    blocks = F.regexp_extract_all(s, F.lit("(?d)<Author[^>]*>(.*?)</Author>"), F.lit(1))
    get = lambda b, tag: F.regexp_extract(b, f"(?d)<{tag}>(.*?)</{tag}>", 1)
    names = F.transform(blocks, lambda b: F.trim(F.concat_ws(" ", F.when(get(b, "LastName") == "", get(b, "CollectiveName")).otherwise(get(b, "LastName")), get(b, "Initials"))))
    short = F.when(F.size(names) > 1, F.concat(F.element_at(names, 1), F.lit(" et al."))).otherwise(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("")))
    return F.struct(names.alias("authors"), F.concat(F.array_join(names, ", "), F.lit(".")).alias("text"), short.alias("short"))
