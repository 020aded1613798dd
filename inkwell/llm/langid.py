"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of two and three bytes.
DIM = 8192
#: Code bits at most; fewer languages have all the useful splits in fewer.
BITS = 31
#: Languages at most: what is gathered from the corpus is one count for each language and n-gram.
MAX_LANGS = 512
#: Texts counted at once.
GROUP = 128
#: Runner-up losses within this of the best are ambiguous.
MARGIN = 0.5

#: Bytes as n-grams see them: ASCII marks, digits and control characters are spaces.
SEEN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)
SEEN[65:91] += 32


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits of the languages if they are at most BITS, else the best of 200 seeded draws.

    Best is the largest smallest distance between two rows. No split has all languages on one side.
    """
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= BITS:
        return np.array([[1 if (s | 1 << (n - 1)) >> i & 1 else -1 for s in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = np.where(rng.permuted(np.tile(np.arange(n)[:, None], (1, BITS)), axis=0) < n // 2, 1.0, -1.0)
        d = (BITS - code @ code.T) / 2 + np.eye(n) * BITS
        if d.min() > apart:
            best, apart = code, d.min()
    return best


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, DIM) counts of hashed byte bigrams and trigrams of lower-cased texts, spaces at both ends."""
    flat = SEEN[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    size = np.array([len(t) + 2 for t in texts])
    row = np.repeat(np.arange(len(texts)) * DIM, size)
    pair = flat[:-1] * np.uint32(257) + flat[1:]
    two = (pair * np.uint32(2654435761)) >> np.uint32(19)
    three = ((pair[:-1] * np.uint32(263) + flat[2:]) * np.uint32(2246822519)) >> np.uint32(19)
    own = row[1:] == row[:-1]  # grams don't cross from one text to the next
    two, three = (row[:-1] + two)[own], (row[:-2] + three)[row[2:] == row[:-2]]
    return (np.bincount(two, minlength=len(texts) * DIM) + np.bincount(three, minlength=len(texts) * DIM)).reshape(len(texts), DIM)


@dataclass
class Model:
    """Languages, codewords, bit classifiers (DIM, bits) scaled to a typical margin of one, and bit weights."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(cls, langs: list[str], counts: np.ndarray) -> Model:
        """Bit classifiers as naive Bayes log-odds between the mean n-gram distributions of the two sides.

        Each language counts alike, however common. A bit's weight is the least margin that it gives any language on
        its own distribution, so that bits that some language's texts can't decide count little.
        """
        code = codewords(len(langs))
        if not langs:
            return cls([], code, np.zeros((DIM, 1), np.float32), np.ones(1))
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * DIM)
        side = lambda s: np.stack([p[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.full(DIM, 1 / DIM) for b in range(code.shape[1])], 1)
        w = np.log(side(1)) - np.log(side(-1))
        margin = (p @ w) * code
        typical = np.maximum(margin.mean(0), 1e-3)
        trust = np.maximum(margin.min(0) / typical, 0.05)
        return cls(langs, code, (w / typical).astype(np.float32), trust / trust.mean())

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and ambiguity of texts that have a letter."""
        n = ngram_counts(texts).astype(np.float32)
        margin = (n @ self.weight) / np.maximum(n.sum(1, keepdims=True), 1)
        loss = np.stack([(self.trust * np.logaddexp(0, -4 * margin * c)).sum(1) for c in self.code], 1)
        gap = loss - loss.min(1, keepdims=True)
        order = np.sort(gap, 1)
        close = order[:, 1] < MARGIN if len(self.langs) > 1 else np.zeros(len(texts), bool)
        return [self.langs[i] for i in loss.argmin(1)], 1 / np.exp(-gap).sum(1), close


def folded(text: Column) -> Column:
    return F.encode(F.lower(F.coalesce(text, F.lit(""))), "UTF-8")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on every row with a language; null texts count as ''. Counts are summed in tasks, then by (language, n-gram);
    one vector of DIM numbers for each language comes to the driver, at most MAX_LANGS of them."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for i in range(0, len(texts), GROUP):
                    n = ngram_counts(texts[i:i + GROUP]).sum(0)
                    total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    src = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), folded(F.col(text_col)).alias("t"))
    sums = src.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = sums.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n"))  # DIM numbers at most
    rows = by_lang.limit(MAX_LANGS + 1).toArrow()
    if rows.num_rows > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found = {lang: (gram.values.to_numpy(), n.values.to_numpy()) for lang, gram, n in zip(rows["lang"].to_pylist(), rows["gram"], rows["n"])}
    counts = np.zeros((len(found), DIM))
    for i, lang in enumerate(sorted(found)):
        counts[i, found[lang][0]] = found[lang][1]
    return Model.fit(sorted(found), counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row, from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Equal texts have
    equal results; repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, letters = b.column(1).to_pylist(), b.column(2).to_pylist()
            lang, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            ask = [i for i, ok in enumerate(letters) if ok and m.langs]
            for k in range(0, len(ask), GROUP):
                part = ask[k:k + GROUP]
                got, s, c = m.predict([texts[i] for i in part])
                score[part], close[part] = s, c
                for i, x in zip(part, got):
                    lang[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    text = F.col(text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), folded(text).alias("t"), letters.alias("letters"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(key: Column, modulus: int = 3) -> Column:
    """Whether crc32 of the key as text leaves 1; a null key counts as ''."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % modulus == 1


def train_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score, ambiguous)."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    out = identify(docs, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


