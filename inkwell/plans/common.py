"""Helpers of the query modules: tables, registration, and text functions as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(into: dict, sql: str | None = None) -> Callable[[Query], Query]:
    """Put a query under its function's name, with its SQL twin."""

    def add(f: Query) -> Query:
        into[f.__name__] = (f, sql)
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def squeeze(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def words(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w_: w_ <> '')"


def fix_period(s: str, drop_blank: bool = False) -> str:
    parts = f"string_split({s}, '.')"
    if drop_blank:
        parts = f"list_filter({parts}, lambda p_: {strip('p_')} <> '')"
    return squeeze(f"array_to_string({parts}, '. ')")


def marks_to_spaces(s: str, marks: str = "all") -> str:
    return f"translate({s}, {lit(K.MARKS[marks])}, {lit(' ' * len(K.MARKS[marks]))})"


def untagged(s: str) -> str:
    """References, inline references and tags to spaces, entities and escapes decoded."""
    s = f"replace({s}, chr(10), ' ')"
    for p in ("<ref-list(.*?)>(.*?)</ref-list>", "</?xref(.*?)>", "</?(.*?)>"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#x02013;", "-")):
        s = f"replace({s}, '{a}', '{b}')"
    return f"regexp_replace({s}, '&#x(.*?);', ' ', 'g')"


def is_data(w: str) -> str:
    return f"regexp_matches({w}, '^[\\p{{Nd}}\\-%.e]*$')"


def masked(tokens: str) -> str:
    """Single characters dropped, figures and data masked."""
    kept = f"list_filter({tokens}, lambda t_: length(t_) > 1 OR {is_data('t_')} OR t_ = 'a')"
    figures = f"list_transform({kept}, lambda t_: CASE WHEN regexp_matches(t_, '(?i)^fig(ure)?([.].*)?$') THEN '{K.FIGURE_MARK}' ELSE t_ END)"
    return f"list_transform({figures}, lambda t_: CASE WHEN {is_data('t_')} THEN '{K.DATA_MARK}' ELSE t_ END)"


def clean_for_search(s: str, variant: str) -> str:
    s = untagged(s)
    if variant == "corpus":
        s = f"regexp_replace({s}, '[^a-zA-Z0-9_.]+', ' ', 'g')"
    s = strip(f"replace({s}, 'et al.', 'et_al')")
    s = fix_period(marks_to_spaces(s, "without_period"), variant != "section")
    s = f"lower(trim(array_to_string({masked(words(f'lower({s})'))}, ' ')))"
    return s if variant == "section" else f"{s} || '.'"


def bag(s: str) -> str:
    """Bag of words of a text cleaned for grams."""
    s = f"regexp_replace(replace(regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g'), chr(10), ' '), '</?(.*?)>', ' ', 'g')"
    return words(f"lower({marks_to_spaces(f'''regexp_replace({s}, '[0-9]+', '', 'g')''')})")


def grams(tokens: str, n: int) -> str:
    if n == 1:
        return f"list_filter({tokens}, lambda t_: length(t_) >= {K.UNIGRAM_LENGTH})"
    return f"list_transform(range(1, greatest(len({tokens}) - {n} + 2, 1)), lambda i_: array_to_string({tokens}[i_:i_ + {n - 1}], ' '))"


def gram_counts(orders=(1, 2, 3)) -> str:
    parts = " UNION ALL ".join(f"SELECT {n} AS n, unnest({grams('bag', n)}) AS gram FROM bags" for n in orders)
    return f"bags AS (SELECT {bag('text')} AS bag FROM documents), counts AS (SELECT n, gram, count(*) AS cnt FROM ({parts}) GROUP BY 1, 2)"
