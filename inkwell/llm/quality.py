"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tidy

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 40_000
#: Hashed words and pairs of words: 2 ** GRAM_BITS buckets.
GRAM_BITS = 14

#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 white space, 4 line end, 5 sentence marks, 6 other marks, 7 not ASCII, 8 control.
KIND = np.full(256, 8, np.int64)
KIND[33:127], KIND[128:] = 6, 7
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
KIND[[9, 11, 12, 13, 32]], KIND[10] = 3, 4
KIND[[ord(c) for c in ".,;:'\"()?-"]] = 5

FEATURES = ("size", "upper", "digit", "space", "lines", "marks", "symbols", "foreign", "control",
            "symbol_words", "word_length", "distinct", "repeats", "line_repeats")


def document_features(text: bytes) -> list[float]:
    """FEATURES of one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    n = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=9)
    words = text.split()
    w, lines = max(1, len(words)), [x for x in text.split(b"\n") if x.strip()]
    marked = sum(x[-1] in b"!#$%&*@^~|<>=+_" or x[0] in b"!#$%&*@^~|<>=+_" for x in words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    letters, size = max(1, n[0] + n[1] + n[7]), len(text)
    return [np.log1p(size), n[1] / letters, n[2] / size, n[3] / size, n[4] / size, n[5] / size, n[6] / size, n[7] / size, n[8] / size,
            marked / w, min(30.0, (size - n[3] - n[4]) / w), len(set(words)) / w ** 0.8, same / w, 1 - len(set(lines)) / max(1, len(lines))]


class Buckets(dict):
    """Word -> 32-bit hash, each reckoned once; emptied when it has many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Distinct buckets of the lower-cased words and pairs of words of a whole text."""
        words = text.lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        pair = (h[:-1] * np.uint32(2654435761) ^ h[1:]) * np.uint32(2246822519)
        return np.unique(np.concatenate([h, pair]) >> np.uint32(32 - GRAM_BITS))


@dataclass
class Model:
    """Log-odds of word n-grams, and the logistic weights of FEATURES, the n-gram evidence and their squares."""

    odds: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes], known: Buckets) -> np.ndarray:
        """Log-odds of each whole text, within 12 either way."""
        x = np.array([[*document_features(t), gram_evidence(self.odds[known.of(t)])] for t in texts])
        return np.clip(np.hstack([x, x * x]) @ self.weights + self.bias, -12, 12)


def gram_odds(good: np.ndarray, bad: np.ndarray, n_good, n_bad) -> np.ndarray:
    """Log-odds of good against bad documents that hold an n-gram, of so many documents each."""
    return np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))


def gram_evidence(odds: np.ndarray) -> float:
    """What a text's distinct n-grams say: their mean log-odds, 0 without any."""
    return float(odds.mean()) if len(odds) else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on features and their squares, by Newton steps; weights for [x, x * x] and bias.

    Without examples of both classes the weights are zero and the bias is the smoothed log-odds.
    """
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    k = x.shape[1] * 2
    if len(np.unique(y)) < 2:
        return np.zeros(k), base
    z = np.hstack([x, x * x])
    mean, spread = z.mean(0), np.maximum(z.std(0), 1e-6)
    z = np.hstack([(z - mean) / spread, np.ones((len(z), 1))])
    w, pull = np.zeros(k + 1), np.r_[np.full(k, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull) + 1e-9 * np.eye(k + 1), z.T @ (y - p) - pull * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    flat = w[:k] / spread
    return flat, float(w[k] - flat @ mean)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(t, y): at most ``rows`` labels with the smallest hash of doc_id, and the texts of those that ``docs`` has.

    A cut through the hashes leaves few more than ``rows`` labels, so that what is sorted, collected or broadcast
    doesn't grow with the labels. Of rows that share an id one counts, that with the smallest hash of its text.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.where("id is not null").withColumn("h", F.xxhash64("id"))
    n = known.count()
    if n > rows:
        known = known.where(F.col("h") <= int(-(1 << 63) + min(1.0, 1.05 * rows / n + 100 / n) * ((1 << 64) - 1)))
    chosen = known.orderBy("h", "id").limit(rows).select("id", "y")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("t"))
    first = F.struct(F.xxhash64("t").alias("h"), F.col("t").alias("k"))
    one = src.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("t", "y"), first).alias("r"))
    return materialize(one.select("r.t", "r.y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, those with the smallest hash of doc_id.

    The n-grams' counts are summed over tasks, 2 ** GRAM_BITS numbers for each class. In fitting the logistic weights,
    a document's own n-grams are taken from the counts first, so that its evidence is that of the others.
    """
    some = labelled(docs, labels, id_col, text_col, rows)
    size = 1 << GRAM_BITS

    def count(batches):
        known, n = Buckets(), np.zeros((2, size + 1), np.int64)
        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[int(y), known.of(t)] += 1
                n[int(y), size] += 1
        y, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[y, at])], ["y", "at", "n"])

    seen, n = some.mapInArrow(tidy(count), "y int, at int, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow(), np.zeros((2, size + 1))
    n[seen["y"].to_numpy(), seen["at"].to_numpy()] = seen["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(n)

    def features(batches):
        known, n = Buckets(), shared.value
        for b in slices(batches):
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, own = known.of(t), np.array([y == 0, y == 1], float)
                bad, good = n[0, at] - own[0], n[1, at] - own[1]
                rows.append([*document_features(t), gram_evidence(gram_odds(good, bad, n[1, size] - own[1], n[0, size] - own[0])), y])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows, float).reshape(-1, len(FEATURES) + 2).T.copy()], names)

    names = [*FEATURES, "grams", "y"]
    found = some.mapInArrow(tidy(features), ", ".join(f"{c} double" for c in names)).toArrow()
    x = np.stack([found[c].to_numpy() for c in names], 1)
    x = x[np.lexsort(x.T)]  # the order of arrival must not matter
    odds = gram_odds(n[1, :size], n[0, :size], n[1, size], n[0, size])
    if not len(x):
        return Model(odds, np.zeros(2 * (len(names) - 1)), 0.0)
    return Model(odds, *fit_logistic(x[:, :-1], x[:, -1]))


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, host, path, z, *carry): log-odds of each whole text. Null text, host or path counts as ''."""
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), *carry, F.encode(text_col, "UTF-8").alias("t"))
    names = src.columns[:-1]

    def run(batches):
        known = Buckets()
        for b in slices(batches):
            z = shared.value.score([t or b"" for t in b.column(len(names)).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z)], [*names, "z"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(tidy(run), f"{kinds}, z double")


class Priors(NamedTuple):
    """The global mean, and how many documents the mean of all hosts and that of a path's host are worth."""

    mean: float
    k_host: float
    k_path: float


def _strength(within: float, between: float) -> float:
    """Documents that a prior is worth: the spread within groups over that between them, which is at least zero."""
    return min(1000.0, max(1.0, within / between)) if between > 0 else 1000.0


def posteriors(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """(host, path, host_n, host_s, path_n, path_s, host_posterior, path_posterior) and the priors.

    ``scored`` has host, path and the classifier's probability p. Hosts are shrunk toward the global mean, and paths
    toward their host's posterior. How much is found by moments: the spread of hosts about the mean, and of paths
    about their host's posterior, less what sampling alone would give them, against the spread of documents within a
    path. One pre-aggregated shuffle by (host, path); everything after is one row for each path, and a few sums reach
    the driver.
    """
    sums = [F.count("*").alias("path_n"), F.sum("p").alias("path_s"), F.sum(F.col("p") * F.col("p")).alias("path_ss")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"), F.sum(F.col("path_n") * F.col("path_n")).alias("nn"))
    n, s, ss, groups = paths.agg(F.sum("path_n"), F.sum("path_s"), F.sum(F.col("path_ss") - F.col("path_s") * F.col("path_s") / F.col("path_n")), F.count("*")).first()
    if not n:
        return paths.join(hosts.drop("nn"), "host").select("host", "path", "host_n", "host_s", "path_n", "path_s", F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), Priors(0.5, 1000.0, 1000.0)
    mean, within = s / n, max(0.0, ss) / max(1, n - groups)
    off, square, count, inner = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - mean, 2)), F.sum(F.col("host_n") * F.col("host_n")), F.count("*"), F.sum(F.col("nn") / F.col("host_n"))).first()
    k_host = _strength(within, (off - (count - 1) * within) / max(1e-9, n - square / n))
    hosts = hosts.select("host", "host_n", "host_s", ((F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).alias("host_posterior"))
    both = paths.join(hosts, "host")
    off = both.agg(F.sum(F.col("path_n") * F.pow(F.col("path_s") / F.col("path_n") - F.col("host_posterior"), 2))).first()[0]
    k_path = _strength(within, (off - (groups - count) * within) / max(1e-9, n - inner)) if groups > count else 1000.0
    shrunk = (F.col("path_s") + k_path * F.col("host_posterior")) / (F.col("path_n") + k_path)
    return both.select("host", "path", "host_n", "host_s", "path_n", "path_s", "host_posterior", shrunk.alias("path_posterior")), Priors(mean, k_host, k_path)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, keep, *carry) for every row of ``docs``.

    ``evidence`` is the probability from the text alone; ``quality`` adds to its log-odds what the path's posterior
    from its other documents says beyond the global mean, so that no document counts twice; ``keep`` is quality >=
    threshold. Empty and null texts have all-zero features and are scored like any other; a very long text is read
    whole. Repeated rows are scored alike and kept as rows; repeated labels count once, by the larger; labels without an
    id count for nothing. With no labels at all evidence is 0.5 everywhere. An empty table gives an empty table; other
    columns are ignored, but for ``carry``, which must not have the names of others.
    """
    model = train(docs, labels, id_col, text_col)
    scored = materialize(evidence(docs, model, id_col, text_col, carry=carry).withColumn("p", 1 / (1 + F.exp(-F.col("z")))))
    sites, prior = posteriors(scored)
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    odds = lambda c: F.log(inside(c) / (1 - inside(c)))
    host = (F.col("host_s") - F.col("p") + prior.k_host * prior.mean) / (F.col("host_n") - 1 + prior.k_host)
    path = (F.col("path_s") - F.col("p") + prior.k_path * host) / (F.col("path_n") - 1 + prior.k_path)
    z = F.col("z") + odds(path) - odds(F.lit(prior.mean))
    out = scored.join(sites, ["host", "path"]).withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("keep"), *carry)
