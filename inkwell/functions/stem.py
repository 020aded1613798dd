"""English stemming by the published Porter and Porter2 rules, over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"

# Fixed values of the published algorithms.
PORTER_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
            ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
            ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
PORTER_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
PORTER_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
           "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
           "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PORTER2_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
             ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
             ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
             ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
PORTER2_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ative", ""), ("ness", ""), ("ful", ""))
PORTER2_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """Porter's stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") and _has_vowel(w[:-2]) else 3 if w.endswith("ing") and _has_vowel(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[:-len(end)] + new if _measure(w[:-len(end)]) > 0 else w
                break
    for end in sorted(PORTER_4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[:-len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _region(w: str, start: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


@lru_cache(maxsize=1 << 16)
def porter2(word: str) -> str:
    """Porter2 (Snowball English) stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", w.lstrip("'"))
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    m = re.search("(eedly|eed)$", w)
    if m:
        w = w[:m.start()] + "ee" if m.start() >= r1 else w
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search("[aeiouy]", w[:m.start()]):
            w = w[:m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in PORTER2_2:
        if w.endswith(end):
            ok = len(w) - len(end) >= r1
            if end == "ogi":
                ok &= w[:-3].endswith("l")
            if end == "li":
                ok &= w[-3:-2] in tuple("cdeghkmnrt")
            w = w[:-len(end)] + new if ok else w
            break
    for end, new in PORTER2_3:
        if w.endswith(end):
            at = len(w) - len(end)
            w = w[:at] + new if at >= (r2 if end == "ative" else r1) else w
            break
    for end in PORTER2_4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(tokens: Column, kind: str = "snowball", stopwords=()) -> Column:
    """Stems of an array of tokens: porter, snowball, snowball_ignore_stop (stop words stay) or none."""
    if kind == "none":
        return tokens
    rule = {"porter": porter, "snowball": porter2, "snowball_ignore_stop": porter2}[kind]
    kept = frozenset(stopwords) if kind == "snowball_ignore_stop" else frozenset()

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [w if w in kept else rule(w) for w in ws])

    return run(tokens)


def separate(costs: dict[str, float], longest: int, s: Column) -> Column:
    """Glued words split at the cheapest places: a word's cost is given, an unknown one costs much for each letter.

    Hyphens split first; marks at a word's end stay with it. The vocabulary is a bounded table that the caller passes.
    """

    def split(word: str) -> str:
        best, back = [0.0], [0]
        for i in range(1, len(word) + 1):
            cost, k = min((best[i - j] + costs.get(word[i - j:i].lower(), 1e3 * j), j) for j in range(1, min(i, longest) + 1))
            best.append(cost), back.append(k)
        out, i = [], len(word)
        while i:
            out.append(word[i - back[i]:i])
            i -= back[i]
        return " ".join(reversed(out)) if best[-1] < 1e3 else word

    def one(text, known):
        if text is None:
            return None
        out = []
        for token in text.split():
            if token not in known:
                m = re.match(r"(.*?)(\W*)$", token)
                known[token] = "-".join(split(p) for p in m[1].split("-")) + m[2]
            out.append(known[token])
        return " ".join(out)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return rows.map(lambda t: one(t, known))

    return run(s)


def word_costs(ranked: list[str]) -> dict[str, float]:
    """Costs of words given by falling frequency, by Zipf's law."""
    from math import log

    return {w: log((i + 1) * log(max(2, len(ranked)))) for i, w in enumerate(ranked)}
