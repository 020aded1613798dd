"""Whole-corpus cleaning and curated sentence databases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import stem
from ..functions import text as T
from . import chunk as C

STOPWORDS = {"none": (), "small": K.DETERMINERS}


def stopwords(option: str) -> tuple[str, ...]:
    """Stop words of an option: none, small (determiners) or whole (the library's English list with letters and digits)."""
    if option == "whole":
        from pyspark.ml.feature import StopWordsRemover

        return (*StopWordsRemover.loadDefaultStopWords("english"), *K.LETTERS_AND_DIGITS)
    return STOPWORDS[option]


def clean_documents(docs: DataFrame, text_col: str = "text", keep=("doc_id",), stop: str = "whole", stemmer: str = "snowball", tagger: C.Tagger = C.rule_tagger) -> DataFrame:
    """(keep, pos, tokens): sentences that pass the cuts, as masked, filtered and stemmed tokens."""
    rows = docs.select(*keep, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "s"))
    rows = rows.select(*keep, "pos", T.corpus_sentence(F.col("s")).alias("s")).where(T.passes_corpus_cuts(F.col("s")))
    rows = rows.select(*keep, "pos", "s", C.tag(F.col("s"), tagger, str.split).alias("w"))
    rows = rows.where(~T.noun_heavy(F.transform("w", lambda w: w["tag"])))
    tokens = rows.select(*keep, "pos", T.corpus_tokens(F.col("s"), stopwords(stop)).alias("t"))
    return tokens.select(*keep, "pos", stem.stem(F.col("t"), stemmer).alias("tokens"))


def curate(sentences: DataFrame, col: str = "sentence", subject: bool = True, be: bool = True, stop: str = "none", stemmer: str = "none", tagger: C.Tagger = C.rule_tagger) -> DataFrame:
    """Sentences with their comparison tokens: subjects, forms of be and pronouns, stop words out, stemmed, as asked."""
    rows = sentences.withColumn("__c", C.chunk(C.tag(F.lower(col), tagger), "SV")) if subject else sentences
    tokens = C.remove_subject(F.col("__c"), placeholder=False) if subject else T.words(F.lower(col))
    rows = rows.withColumn("tokens", tokens).drop("__c")
    t = F.col("tokens")
    if be:
        t = T.drop_listed(t, (*K.BE_FORMS, K.BE_MARK, *K.PRONOUNS))
    if stop != "none":
        t = T.drop_listed(t, stopwords(stop))
    rows = rows.withColumn("tokens", t)
    return rows if stemmer == "none" else rows.withColumn("tokens", stem.stem(F.col("tokens"), stemmer))


def wordwise_columns(df: DataFrame, cols: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """One function over several columns."""
    return df.withColumns({c: f(F.col(c)) for c in cols})
