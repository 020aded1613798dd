"""Determiner suggestions for noun phrases from what earlier sentences mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunk as C

# Words whose first sound differs from their first letter, and plurals without s.
VOWEL_SOUND = ("hour", "hours", "honest", "honor", "heir")
CONSONANT_SOUND = ("europe", "european", "one", "once", "use", "used", "useful", "user", "unit", "university", "union", "unique", "uniform")
PLURALS = ("men", "women", "people", "children", "mice", "data", "criteria", "phenomena", "feet", "teeth")


def vowel_sound(w: Column) -> Column:
    low = F.lower(w)
    return F.when(low.isin(*VOWEL_SOUND), True).when(low.isin(*CONSONANT_SOUND), False).otherwise(T.starts_with_vowel(w))


def is_singular(noun: Column) -> Column:
    """By the last word: known plurals and words in s but not ss, us or is are plural."""
    last = F.lower(F.element_at(F.split(noun, " "), -1))
    return ~(last.isin(*PLURALS) | (last.rlike("s$") & ~last.rlike("(ss|us|is)$")))


def suggest(sentences: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "sentence", tagger: C.Tagger = C.rule_tagger) -> DataFrame:
    """(doc, pos, part, noun, suggestion) for each part of each noun phrase; null where nothing is suggested.

    A part without determiner whose noun an earlier sentence of the document mentions gets this or these if the last
    sentence does, by number, else the. 'a' before a vowel sound becomes an, and the other way round.
    """
    parts = sentences.select(doc, pos, C.noun_parts(F.col(text), tagger).alias("parts")).withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(pos)))
    rows = parts.select(doc, pos, "rank", F.posexplode("parts").alias("part", "p")).select(doc, pos, "rank", "part", "p.*")
    earlier = Window.partitionBy(doc, "noun").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.max("rank").over(earlier))
    mention = F.when(F.col("before") == F.col("rank") - 1, F.when(is_singular(F.col("noun")), "this").otherwise("these")).otherwise("the")
    told = (F.when(F.col("alone"), F.lit(None))
            .when(F.col("det").isNull(), F.when(F.col("before").isNotNull(), mention))
            .when((F.col("det") == "a") & vowel_sound(F.col("following")), "an").when((F.col("det") == "an") & ~vowel_sound(F.col("following")), "a"))
    return rows.select(doc, pos, "part", "noun", told.alias("suggestion"))
