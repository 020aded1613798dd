"""N-gram vocabularies: counts, merges, top-k, lead dictionaries and autocomplete ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import stored

#: Characters of the texts whose grams are counted together in a task: its memory, whatever it reads.
CHARS = 1 << 25


def clean_for_grams(s: Column) -> Column:
    """Non-ASCII and null characters deleted, line ends and tags to spaces."""
    return T.tags_to_spaces(T.line_breaks_to_spaces(T.remove_null_chars(T.remove_non_ascii(s))))


def tagged(gram: Column, n: int) -> Column:
    """Grams with their order."""
    return F.transform(gram, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def gram_stream(df: DataFrame, text_col: str = "text", orders=(1, 2, 3)) -> DataFrame:
    """(n, gram): every gram of each text. Unigrams have four letters or more; longer grams are of all words.

    Grams don't cross texts. Texts are tokenized once and exploded once.
    """
    bag = df.select(T.bag_of_words(clean_for_grams(F.col(text_col))).alias("bag"))
    parts = []
    for n in orders:
        gram = F.filter("bag", lambda w: F.length(w) >= K.UNIGRAM_LENGTH) if n == 1 else T.grams(F.col("bag"), n)
        parts.append(tagged(gram, n))
    return bag.select(F.explode(F.concat(*parts)).alias("g")).select("g.n", "g.gram")


def spread(words: pa.Array, size: np.ndarray, orders) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, start, key) for each order: where each gram of texts of so many ``words`` each begins, and a number that is the
    same for equal grams only."""
    coded = words.dictionary_encode()
    code, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # words from here to the end of the text
    key, most = code, many
    for n in range(1, max(orders) + 1):
        if n > 1:
            if most * many >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                most = len(key)
            key, most = key[:-1] * many + code[n - 1:], most * many
        if n in orders:
            start = np.flatnonzero(left[:len(key)] >= n)
            yield n, start, key[start]


def _counted(orders):
    """Grams (n, gram, cnt) of a task's texts, words between single spaces, counted by CHARS characters at a time."""

    def counts(held):
        split = pc.split_pattern(pa.concat_arrays(held), " ")
        words, size = split.flatten(), pc.list_value_length(split).to_numpy()
        for n, start, key in spread(words, size, orders):
            if n == 1:
                start, key = (x[pc.greater_equal(pc.utf8_length(words), K.UNIGRAM_LENGTH).to_numpy(zero_copy_only=False)[start]] for x in (start, key))
            _, first, cnt = np.unique(key, return_index=True, return_counts=True)
            for s in range(0, len(first), 1 << 18):
                at = start[first[s:s + (1 << 18)]]
                gram = pc.binary_join_element_wise(*[words.take(pa.array(at + i)) for i in range(n)], " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), gram, pa.array(cnt[s:s + (1 << 18)].astype(np.int64))], ["n", "gram", "cnt"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).filter(pc.fill_null(pc.not_equal(b.column(0), ""), False)))
            size += pc.sum(pc.binary_length(held[-1])).as_py() or 0
            if size >= CHARS:
                yield from counts(held)
                held, size = [], 0
        if held:
            yield from counts(held)

    return run


def count_grams(df: DataFrame, text_col: str = "text", orders=(1, 2, 3)) -> DataFrame:
    """(n, gram, cnt), exact: texts are tokenized once, grams are counted by number in tasks, and one shuffle adds up.

    Grams are as in ``gram_stream``. What tasks counted moves before it is added up, so no task holds a table of its own.
    """
    bag = df.select(F.array_join(T.bag_of_words(clean_for_grams(F.col(text_col))), " ").alias("bag"))
    return bag.mapInArrow(_counted(tuple(orders)), "n int, gram string, cnt long").repartition("n", "gram").groupBy("n", "gram").agg(F.sum("cnt").alias("cnt"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Sum of partial counts; grams whose sum isn't positive go."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("n", "gram").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def keep_top(counts: DataFrame, top: dict[int, int] = K.GRAM_TOP) -> DataFrame:
    """The most frequent grams of each order; equals by gram.

    Each order is one sorted limit, so every task passes on at most k rows instead of a whole order meeting in one.
    """
    out = None
    for n, k in sorted(top.items()):
        part = counts.where(F.col("n") == n).orderBy(F.desc("cnt"), "gram").limit(k)
        out = part if out is None else out.unionByName(part)
    return out


def _best(top: dict[int, int]):
    """The most frequent grams (n, gram, cnt) of a task for each order, equals by gram."""
    order = [("cnt", "descending"), ("gram", "ascending")]

    def run(batches):
        held = {n: pa.table({"gram": pa.array([], pa.string()), "cnt": pa.array([], pa.int64())}) for n in top}
        for b in batches:
            for n, k in top.items():
                some = pa.Table.from_batches([b]).filter(pc.equal(b.column(0), n)).select(["gram", "cnt"])
                if held[n].num_rows >= k:
                    some = some.filter(pc.greater_equal(some["cnt"], pc.min(held[n]["cnt"])))
                both = pa.concat_tables([held[n], some]).combine_chunks()
                held[n] = both.take(pc.select_k_unstable(both, k, order)) if both.num_rows > k else both
        for n, rows in held.items():
            for b in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, n, np.int32)), *b.columns], ["n", "gram", "cnt"])

    return run


def top_grams(df: DataFrame, text_col: str = "text", top: dict[int, int] = K.GRAM_TOP) -> DataFrame:
    """The most frequent grams of a table of texts, of all orders in one pass. Tasks pass on their best of each order."""
    counts = count_grams(df, text_col, tuple(top))
    if len(top) == 1:
        return counts.orderBy(F.desc("cnt"), "gram").limit(*top.values())
    best = counts.select("n", "gram", "cnt").mapInArrow(_best(top), "n int, gram string, cnt long")
    most = F.create_map(*[F.lit(x) for pair in top.items() for x in pair])
    return best.withColumn("__r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cnt"), "gram"))).where(F.col("__r") <= most[F.col("n")]).drop("__r")


def lead_entries(counts: DataFrame) -> DataFrame:
    """(n, lead, phrase, cur, freq): a gram as its first words and its last."""
    split = r"^(.*) (\S+)$"
    return counts.where("n > 1").select(
        "n", F.regexp_extract("gram", split, 1).alias("lead"), F.col("gram").alias("phrase"),
        F.regexp_extract("gram", split, 2).alias("cur"), F.col("cnt").alias("freq"))


def lead_dictionary(counts: DataFrame) -> DataFrame:
    """(n, lead, entries): continuations of each lead, most frequent first. One entry for each gram of the kept vocabulary."""
    entry = F.struct((-F.col("freq")).alias("order"), "phrase", "cur", "freq")
    grouped = lead_entries(counts).groupBy("n", "lead").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select("n", "lead", F.transform("e", lambda x: F.struct(x["phrase"].alias("phrase"), x["cur"].alias("cur"), x["freq"].alias("freq"))).alias("entries"))


def vocabulary(df: DataFrame, subject: str, text_col: str = "text", top: dict[int, int] = K.GRAM_TOP) -> DataFrame:
    """One document: subject, three frequency maps, two lead dictionaries, interpolation weights. Bounded by ``top``."""
    kept = stored(top_grams(df, text_col, top), "grams")
    freq = lambda n: F.map_from_entries(F.collect_list(F.when(F.col("n") == n, F.struct("gram", "cnt"))))
    names = {1: "unigram", 2: "bigram", 3: "trigram"}
    counts = kept.agg(*[freq(n).alias(f"{names[n]}_freq") for n in (1, 2, 3)])
    leads = lead_dictionary(kept)
    listed = lambda n: F.map_from_entries(F.collect_list(F.when(F.col("n") == n, F.struct("lead", "entries"))))
    dicts = leads.agg(*[listed(n).alias(f"{names[n]}_dict") for n in (2, 3)])
    weights = F.create_map(*[x for n, w in zip((1, 2, 3), K.AUTOCOMPLETE_WEIGHTS) for x in (F.lit(names[n]), F.lit(w))])
    return counts.withColumn("one", F.lit(1)).join(dicts.withColumn("one", F.lit(1)), "one").select(F.lit(subject).alias("subject"), *counts.columns, *dicts.columns, weights.alias("interpolation_model"))


def context_leads(line: Column) -> Column:
    """The last word and the last two words of a line: (lead1, lead2), '' where there are too few."""
    w = T.words(line)
    take = lambda k: F.when(F.size(w) >= k, F.array_join(F.slice(w, F.size(w) - k + 1, k), " ")).otherwise(F.lit(""))
    return F.struct(take(1).alias("lead1"), take(2).alias("lead2"))


def autocomplete_rank(counts: DataFrame, prefix: str, lead1: str = "", lead2: str = "") -> DataFrame:
    """(gram, score): unigrams with the prefix, by their own, bigram and trigram counts after the context, weighted."""
    w1, w2, w3 = K.AUTOCOMPLETE_WEIGHTS
    uni = counts.where((F.col("n") == 1) & F.startswith(F.col("gram"), F.lit(prefix))).select("gram", F.col("cnt").alias("f1"))
    after = lambda n, lead, name: lead_entries(counts).where((F.col("n") == n) & (F.col("lead") == lead)).select(F.col("cur").alias("gram"), F.col("freq").alias(name))
    both = uni.join(after(2, lead1, "f2"), "gram", "left").join(after(3, lead2, "f3"), "gram", "left").fillna(0, ["f2", "f3"])
    return both.select("gram", (w1 * F.col("f1") + w2 * F.col("f2") + w3 * F.col("f3")).alias("score"))


def autocomplete_chain(counts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(pos, phrase, level): ranked unigrams, then for each in order its bigrams by frequency, then for each its trigrams.

    ``ranked`` is the answer to one prefix; the chain is as small, so one ordering numbers it.
    """
    leads = lead_entries(counts)
    uni = ranked.select(F.struct((-F.col("score")).alias("s"), "gram").alias("r1"), F.col("gram").alias("phrase"))
    bi = uni.join(leads.where("n = 2").select(F.col("lead").alias("l"), F.col("phrase").alias("p"), "freq"), F.col("phrase") == F.col("l"))
    bi = bi.select("r1", F.struct((-F.col("freq")).alias("s"), F.col("p").alias("gram")).alias("r2"), F.col("p").alias("phrase"))
    tri = bi.join(leads.where("n = 3").select(F.col("lead").alias("l"), F.col("phrase").alias("p"), "freq"), F.col("phrase") == F.col("l"))
    tri = tri.select("r1", "r2", F.struct((-F.col("freq")).alias("s"), F.col("p").alias("gram")).alias("r3"), F.col("p").alias("phrase"))
    none = F.lit(None).cast("struct<s:bigint,gram:string>")
    rows = (uni.select("phrase", F.lit(1).alias("level"), "r1", none.alias("r2"), none.alias("r3"))
            .union(bi.select("phrase", F.lit(2), "r1", "r2", none)).union(tri.select("phrase", F.lit(3), "r1", "r2", "r3")))
    return rows.select(F.row_number().over(Window.orderBy("level", "r1", "r2", "r3")).alias("pos"), "phrase", "level")


def sum_top(counts: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """Sum of each group's k largest values; a group's values are bounded by its states."""
    best = counts.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value)))).where(F.col("__r") <= k)
    return best.groupBy(group).agg(F.sum(value).alias("top_sum"))


def most_frequent(tokens: Column) -> Column:
    """(word, times) of the most frequent word, the first in order among equals."""
    each = F.transform(F.array_sort(F.array_distinct(tokens)), lambda w: F.struct(F.size(F.filter(tokens, lambda x: x == w)).alias("times"), w.alias("word")))
    return F.reduce(each, F.struct(F.lit(0).alias("times"), F.lit("").alias("word")), lambda a, x: F.when(x["times"] > a["times"], x).otherwise(a))
