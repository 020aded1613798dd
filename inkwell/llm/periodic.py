"""Stretches of words that repeat with a period: lags by counted matches, islands at the lags that have enough."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Words that a run has at least; it also has its period twice.
LEAST = 12
#: Words compared at once at first while an island is followed to its ends; the step doubles.
FIRST_STEP = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words(text: Column) -> Column:
    """Words of a text: what stands between ASCII white space. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")


def needed(lag: int) -> int:
    """Matches in a row that a run with this period has at least."""
    return max(LEAST - lag, lag)


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """At index q, how many words equal the word q places on, for q up to ``most``.

    Words with more than about the root of n log n places go through one exact autocorrelation by FFT for all of them:
    the power spectra of their indicator sequences are summed before the inverse transform, whose values are whole
    numbers to within far less than a half. Of the others, each pair of places is counted by its difference.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    _, count = np.unique(ids, return_counts=True)
    heavy = count > max(16.0, np.sqrt(n * np.log2(n + 2)))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(most + 1, np.int64)
    if heavy.any():
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for k in np.flatnonzero(heavy):
            seen = np.zeros(size)
            seen[order[first[k]:first[k + 1]]] = 1
            f = np.fft.rfft(seen)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[:most + 1]).astype(np.int64)
    light = np.repeat(~heavy, count)
    place, word = order[light], np.repeat(np.arange(len(count)), count)[light]
    at = np.arange(len(place))
    step = 1
    while len(at):
        at = at[:np.searchsorted(at, len(place) - step)]
        at = at[word[at + step] == word[at]]
        gap = place[at + step] - place[at]
        out += np.bincount(gap[gap <= most], minlength=most + 1)
        step += 1
    out[0] = 0
    return out


def _end(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries of two arrays of one length are equal, in steps that double."""
    at, step = 0, FIRST_STEP
    while at < len(a):
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, length, smallest period) of runs, by start and period, of a sequence of word numbers.

    A run is a stretch as long as LEAST and twice its period that can't be extended. At a lag with enough matches in
    all, places far enough apart that an island holds four of them in a row are probed, and only where four in a row
    match is the island followed to its ends. Probes within a known run whose period divides the lag would find that
    run again and are left out, so a long run costs its later lags no more than probes.
    """
    n = len(ids)
    most = n // 2
    if n < LEAST:
        return []
    total = lag_matches(ids, most)
    lags = np.arange(most + 1)
    found: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for q in np.flatnonzero(total >= np.maximum(LEAST - lags, np.maximum(lags, 1))).tolist():
        step = needed(q) // 4
        here = ids[:n - q:step] == ids[q::step]
        four = np.flatnonzero(here[:-3] & here[1:-2] & here[2:-1] & here[3:]) * step
        for period, (starts, ends) in found.items():
            if len(four) and q % period == 0:
                k = np.searchsorted(starts, four, "right") - 1
                four = four[(k < 0) | (four + q >= np.array(ends)[k])]
        past = 0
        for i in four.tolist():
            if i < past:
                continue
            a, b = ids[:n - q], ids[q:]
            past = i + _end(a[i:], b[i:])
            start = i - _end(a[:i][::-1], b[:i][::-1])
            if past - start >= needed(q) and not _known(found, q, start, past + q):
                starts, ends = found.setdefault(q, ([], []))
                starts.append(start)
                ends.append(past + q)
                out.append((start, past + q - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _known(found: dict, q: int, start: int, end: int) -> bool:
    """Whether a run with a smaller period that divides q has the same ends."""
    for period, (starts, ends) in found.items():
        if q % period == 0 and period < q:
            k = bisect_right(starts, start) - 1
            if k >= 0 and starts[k] == start and ends[k] == end:
                return True
    return False


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each whole text by start and period, and the text without the
    words that repeat a run's first period, joined by one space.

    Words are cut by Spark and numbered for each batch by Arrow's dictionary, so tasks compare numbers. Null and empty
    texts have no words, no runs and collapse to ''. Repeated rows stay, a null id stays null; an empty table gives an
    empty table; other columns are ignored. A very long text takes one task and about a hundred bytes a word; time
    grows with n ** 1.5 for the counts, and with the probes, which are n / lag at each lag that has enough matches.
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in slices(batches):
            flat, ends = b.column(1).flatten(), np.cumsum([0, *b.column(1).value_lengths().to_pylist()])
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            runs, kept, left = [], [], [0]
            for i, j in zip(ends.tolist(), ends[1:].tolist()):
                found = find_runs(ids[i:j])
                runs.append(found)
                keep = ~repeated(j - i, found) if found else np.ones(j - i, bool)
                kept.append(keep)
                left.append(left[-1] + int(keep.sum()))
            rows = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
            at = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(struct)))
            rest = flat.filter(pa.array(np.concatenate(kept))) if kept else flat
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), listed, pa.ListArray.from_arrays(pa.array(left, pa.int32()), rest)], ["doc_id", "n_words", "runs", "kept"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    out = src.mapInArrow(tidy(run), f"doc_id long, n_words long, runs {RUNS}, kept array<string>")
    return out.select("doc_id", "n_words", "runs", F.array_join("kept", " ").alias("collapsed"))


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with one repeated stretch in a tenth of the texts, chosen and placed by the CRC-32 of the id as text.

    A null id counts as ''; a text without words stays as it is.
    """
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    w = words(F.col("text"))
    hashed = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    some = F.when(hashed % 10 == 0, w)  # null for the others, which aren't cut into words here
    doc = doc.select("doc_id", "text", F.floor(hashed / 10).cast("long").alias("g"), some.alias("w"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("long")
    doc = doc.select("doc_id", "text", "w", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    planted = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return doc.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run (ties:
    smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
                      F.expr("(1000 * b.length) div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
