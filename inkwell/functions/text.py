"""Text functions: Column in, Column out. Everything stays in Catalyst expressions.

``tokens`` parameters are arrays of strings. Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# Characters


def remove_chars(s: Column, chars: str, space: bool = False) -> Column:
    """Delete each of ``chars``, or put a space in its place."""
    return F.translate(s, chars, " " * len(chars) if space else "")


def remove_null_chars(s: Column, space: bool = False) -> Column:
    return F.replace(s, F.lit("\0"), F.lit(" " if space else ""))


def remove_digits(s: Column, space: bool = True) -> Column:
    """Runs of digits become one space, or nothing."""
    return F.regexp_replace(s, "[0-9]+", " " if space else "")


def remove_references(s: Column) -> Column:
    return F.regexp_replace(s, r"(?d)<ref-list(.*?)>(.*?)</ref-list>", " ")


def remove_inline_references(s: Column) -> Column:
    return F.regexp_replace(s, r"(?d)</?xref(.*?)>", " ")


def tags_to_spaces(s: Column) -> Column:
    return F.regexp_replace(s, r"(?d)</?(.*?)>", " ")


def remove_tags(s: Column, strip: bool = True) -> Column:
    """Tags are deleted; ``strip`` also trims the ends."""
    out = F.regexp_replace(s, r"(?d)<(.*?)>", "")
    return trim(out) if strip else out


def remove_html_escapes(s: Column) -> Column:
    return F.regexp_replace(s, r"(?d)&#x(.*?);", " ")


def dash_escapes(s: Column) -> Column:
    return F.replace(s, F.lit("&#x02013;"), F.lit("-"))


def decode_entities(s: Column) -> Column:
    """&amp; first, then &lt; and &gt;, so that an escaped entity is decoded twice."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def line_breaks_to_spaces(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit(" "))


def trim(s: Column) -> Column:
    """White space in the Unicode sense off both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def words(s: Column) -> Column:
    """Words between white space in the Unicode sense; none for an empty text."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def count_squeezed(s: Column) -> Column:
    """How many words a squeezed text has."""
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def fix_period(s: Column, drop_blank: bool = False) -> Column:
    """A space after each period. ``drop_blank`` leaves out pieces without content."""
    parts = F.split(s, "[.]")
    if drop_blank:
        parts = F.filter(parts, lambda p: trim(p) != "")
        return squeeze(F.array_join(parts, ". "))
    return squeeze(F.array_join(parts, ". "))


def marks_to_spaces(s: Column, marks: str = "all") -> Column:
    return F.translate(s, K.MARKS[marks], " " * len(K.MARKS[marks]))


def remove_marks(s: Column) -> Column:
    return F.translate(s, K.ALL_MARKS, "")


def keep_words_and_periods(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z0-9_.]+", " ")


def keep_letters(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z_]+", " ")


def non_ascii_to_spaces(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]+", " ")


def remove_non_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def join_et_al(s: Column) -> Column:
    return trim(F.replace(s, F.lit("et al."), F.lit("et_al")))


def mask_section_index(s: Column) -> Column:
    return trim(F.regexp_replace(s, r"([0-9]\.)+", "section_index"))


def repair_line_wrap(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("- "), F.lit("")), F.lit(" -"), F.lit(""))


def cap_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


# Predicates


def is_data(w: Column) -> Column:
    """Every character is a digit or one of - % . e; true for the empty word."""
    return w.rlike(r"^[\p{Nd}\-%.e]*$")


def all_digits(s: Column) -> Column:
    """All characters but spaces are digits; true for a blank text."""
    return s.rlike(r"(?U)^[0-9\s]*$")


def starts_upper(s: Column) -> Column:
    return s.rlike(r"^\p{Lu}")


def starts_digit(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}")


def digit_share(s: Column) -> Column:
    """Digits among characters other than white space; 1 for a blank text."""
    return _share(s, F.length(F.regexp_replace(s, "[^0-9]+", "")))


def mark_share(s: Column) -> Column:
    """ASCII marks among characters other than white space; 1 for a blank text."""
    return _share(s, F.length(s) - F.length(F.regexp_replace(s, r"[!-/:-@\[-`{-~]+", "")))


def _share(s: Column, n: Column) -> Column:
    size = F.length(F.regexp_replace(s, r"(?U)\s", ""))
    return F.when(size == 0, F.lit(1.0)).otherwise(n / size)


def ends_et_al(s: Column) -> Column:
    return F.endswith(s, F.lit("et al"))


def most_repeats(tokens: Column) -> Column:
    """How often the most frequent token occurs; 0 for none. The longest run of the sorted tokens, so the work is not
    the square of a long sentence."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a, w):
        run = F.when(w == a["word"], a["run"] + 1).otherwise(1)
        return F.when(w.isNull(), a).otherwise(F.struct(w.alias("word"), run.alias("run"), F.greatest(a["most"], run).alias("most")))

    return F.coalesce(F.reduce(F.sort_array(tokens), start, step, lambda a: a["most"]), F.lit(0))


def is_section_title(line: Column, following: Column, cut: int = 7) -> Column:
    """A short line without a final period before a line that starts upper or with a digit."""
    return ~F.endswith(trim(line), F.lit(".")) & (starts_upper(following) | starts_digit(following)) & (F.size(words(line)) <= cut)


def starts_with_vowel(w: Column) -> Column:
    """Letter test: the part before a hyphen; an all-capitals word by the sound of its first letter's name."""
    head = F.element_at(F.split(w, "-"), 1)
    return F.when(head.rlike("^[A-Z]{2,}$"), head.rlike("^[AEFHILMNORSX]")).otherwise(head.rlike("(?i)^[aeiou]"))


def as_boolean(s: Column) -> Column:
    """true in any case is true; all else, null included, false."""
    return F.coalesce(F.lower(s) == "true", F.lit(False))


def or_na(s: Column) -> Column:
    """Missing or blank becomes N/A."""
    return F.coalesce(F.nullif(trim(s), F.lit("")), F.lit("N/A"))


def underscored(s: Column) -> Column:
    return F.translate(s, " ", "_")


def spaced(s: Column) -> Column:
    return F.translate(s, "_", " ")


# Tokens


def drop_listed(tokens: Column, listed) -> Column:
    """Without tokens whose lower case is in the list."""
    return F.filter(tokens, lambda w: ~F.lower(w).isin(*listed))


def drop_short(tokens: Column, cut: int) -> Column:
    """Tokens of more than ``cut`` characters."""
    return F.filter(tokens, lambda w: F.length(w) > cut)


def drop_single(tokens: Column) -> Column:
    """Tokens of one character go, but for data and 'a'."""
    return F.filter(tokens, lambda w: (F.length(w) > 1) | is_data(w) | (w == "a"))


def drop_blank(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w.rlike(r"(?U)\S"))


def drop_data(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~is_data(w))


def mask_data(tokens: Column, mark: str = K.DATA_MARK) -> Column:
    return F.transform(tokens, lambda w: F.when(is_data(w), F.lit(mark)).otherwise(w))


def mask_figures(tokens: Column, mark: str = K.FIGURE_MARK) -> Column:
    return F.transform(tokens, lambda w: F.when(w.rlike("(?i)^fig(ure)?([.].*)?$"), F.lit(mark)).otherwise(w))


def _mask_listed(tokens: Column, listed, mark: str) -> Column:
    return F.transform(tokens, lambda w: F.when(F.lower(w).isin(*listed), F.lit(mark)).otherwise(w))


def mask_be(tokens: Column, mark: str = K.BE_MARK) -> Column:
    return _mask_listed(tokens, K.BE_FORMS, mark)


def mask_pronouns(tokens: Column, mark: str = K.PRONOUN_MARK) -> Column:
    return _mask_listed(tokens, K.PRONOUNS, mark)


def wordwise(s: Column, *steps: Callable[[Column], Column]) -> Column:
    """Split, run token steps in order, join by spaces and trim."""
    tokens = words(s)
    for step in steps:
        tokens = step(tokens)
    return F.trim(F.array_join(tokens, " "))


def group_of(items: Column, n: int) -> Column:
    """Overlapping groups of n neighbours; none if there are fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def grams(tokens: Column, n: int) -> Column:
    """Neighbouring tokens joined by a space."""
    return F.transform(group_of(tokens, n), lambda g: F.array_join(g, " "))


def subwords(word: Column, n: int, whole: bool = False, ends: bool = False) -> Column:
    """Character n-grams; a shorter word is itself. ``whole`` adds the word, ``ends`` its prefixes and suffixes below n."""
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))
    out = F.when(F.length(word) < n, F.array(word)).otherwise(inner)
    if ends:
        sizes = F.sequence(F.lit(1), F.lit(n - 1))
        edge = F.concat(F.transform(sizes, lambda k: F.substr(word, F.lit(1), k)), F.transform(sizes, lambda k: F.right(word, k)))
        out = F.when(F.length(word) < n, out).otherwise(F.concat(out, edge))
    return F.array_distinct(F.concat(out, F.array(word))) if whole else out


def left_edges(word: Column, least: int) -> Column:
    """Prefixes of at least ``least`` characters, the word among them; a shorter word is itself."""
    cut = F.transform(F.sequence(F.lit(least), F.greatest(F.length(word), F.lit(least))), lambda k: F.substr(word, F.lit(1), k))
    return F.when(F.length(word) <= least, F.array(word)).otherwise(cut)


def token_set(s: Column, stopwords=()) -> Column:
    """Distinct lower-case words without stop words."""
    tokens = words(F.lower(s))
    return F.array_distinct(drop_listed(tokens, stopwords) if stopwords else tokens)


def subword_set(tokens: Column, n: int = 5) -> Column:
    return F.array_distinct(F.flatten(F.transform(tokens, lambda w: subwords(w, n))))


def coverage(query: Column, segment: Column) -> Column:
    """Share of the query's set that the segment's set has; 1 for an empty query."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(q, segment)) / F.size(q))


def percent_hit(query: Column, segment: Column) -> Column:
    """Distinct query tokens found, by the number of query tokens, repeats included; null for none."""
    return F.try_divide(F.size(F.array_intersect(query, segment)), F.size(query))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance without spaces, by the longer length with spaces; 0 for two empty texts."""
    bare = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(bare(a), bare(b)) / longest)


def insert_at(s: Column, content: Column, line: Column, position: Column) -> Column:
    """Put content at a place in a line, both counted from 0; a line beyond the last changes nothing."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x, i: F.when(i == line, F.concat(F.substr(x, F.lit(1), position), content, F.substr(x, position + 1))).otherwise(x)), "\n")


def numbers_to_text(xs: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), sep)


# Pipelines


def clean_lightly(s: Column, final_period: bool = True) -> Column:
    """Line ends, references, tags, entities and dashes cleaned up, a space after periods."""
    for step in (line_breaks_to_spaces, remove_references, remove_inline_references, tags_to_spaces, decode_entities, dash_escapes, remove_html_escapes, fix_period):
        s = step(s)
    return F.concat(s, F.lit(".")) if final_period else s


def clean_for_search(s: Column, variant: str = "corpus") -> Column:
    """Normalised sentences with data and figures masked.

    Variants differ as their users did: ``corpus`` drops all but letters, digits, _ and periods first, drops blank
    pieces and adds a final period; ``abstract`` keeps other letters; ``section`` keeps blank pieces and adds none.
    """
    s = remove_html_escapes(dash_escapes(decode_entities(tags_to_spaces(remove_inline_references(remove_references(line_breaks_to_spaces(s)))))))
    if variant == "corpus":
        s = keep_words_and_periods(s)
    s = marks_to_spaces(join_et_al(s), "without_period")
    s = fix_period(s, drop_blank=variant != "section")
    s = F.lower(wordwise(F.lower(s), drop_single, mask_figures, mask_data))
    return s if variant == "section" else F.concat(s, F.lit("."))


def clean_query(s: Column) -> Column:
    """A search query as its segments were normalised; underscores stay."""
    return F.lower(wordwise(F.lower(marks_to_spaces(s, "without_connection")), drop_single, mask_figures, mask_data))


def clean_segment(s: Column) -> Column:
    return squeeze(keep_words_and_periods(marks_to_spaces(trim(s))))


def phrase_text(tokens: Column) -> Column:
    """Words of a pattern as a lower-case phrase."""
    return squeeze(F.lower(marks_to_spaces(keep_words_and_periods(F.array_join(tokens, " ")))))


def bag_of_words(s: Column) -> Column:
    """Digits deleted, marks to spaces, lower case, split."""
    return words(F.lower(marks_to_spaces(remove_digits(s, space=False))))


def sentences(s: Column) -> Column:
    """Pieces between periods, trimmed; the piece after the last period is one of them."""
    return F.transform(F.split(s, "[.]"), trim)


def paragraphs(s: Column) -> Column:
    return F.split(s, "\n")


def segments(s: Column) -> Column:
    """Pieces between '. ' that aren't empty."""
    return F.filter(F.split(s, "[.] "), lambda x: x != "")


def plain_tokens(s: Column) -> Column:
    """Tags and marks deleted, split at spaces, case kept."""
    bare = line_breaks_to_spaces(remove_marks(remove_tags(s, strip=False)))
    return F.filter(F.split(bare, " "), lambda w: w != "")


def passes_corpus_cuts(s: Column) -> Column:
    """Few digits and marks, long enough, no citation tail, no word too often."""
    return (F.length(s) > K.LENGTH_CUT) & ~ends_et_al(s) & (digit_share(s) < K.DIGIT_CUT) & (mark_share(s) < K.MARK_CUT) & (most_repeats(words(s)) <= K.REPEAT_CUT)


def noun_heavy(tags: Column, cut: int = K.NOUN_CUT) -> Column:
    """As many nouns or adjectives as the cut, by their plain tags."""
    count = lambda t: F.size(F.filter(tags, lambda x: x == t))
    return F.greatest(count("NN"), count("JJ")) >= cut


def corpus_tokens(s: Column, stopwords=K.DETERMINERS) -> Column:
    """Tokens of a cleaned sentence: data, figures, be and pronouns masked; stop words, surnames, figure ids and letters dropped."""
    tokens = mask_pronouns(mask_be(mask_figures(mask_data(words(s)))))
    for listed in (stopwords, K.SURNAMES, K.FIGURE_IDS, K.SINGLE_LETTERS):
        tokens = drop_listed(tokens, listed) if listed else tokens
    return tokens


def corpus_sentence(s: Column) -> Column:
    """A raw sentence before the cuts: trimmed, lower case, marks to spaces, wrapped words joined."""
    return repair_line_wrap(marks_to_spaces(F.lower(trim(s))))
