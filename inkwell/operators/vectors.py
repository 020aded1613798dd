"""Vectors: normalising, nearest neighbours, sentence embeddings, similarity of words and sentences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

#: Entries beyond this could overflow when squared; rows of a table compared at a time.
LARGEST, ROWS = 1e100, 2_000
#: Numbers of a vector that are summed as columns; word counts of a batch.
COLUMNS, COUNTS = 64, 1 << 17


def dot(u: Column, v: Column) -> Column:
    return F.reduce(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(u: Column, v: Column) -> Column:
    return F.reduce(F.zip_with(u, v, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v by its length, which is reckoned once; a zero vector stays."""
    sized = F.transform(F.array(v), lambda u: F.struct(u.alias("v"), norm(u).alias("n")))
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x.cast("double")).otherwise(x.cast("double") / s["n"]))
    return F.transform(sized, scaled)[0]


def cosine(u: Column, v: Column) -> Column:
    """Cosine, 0 if either is a zero vector."""
    return F.coalesce(F.try_divide(dot(u, v), norm(u) * norm(v)), F.lit(0.0))


def parse_lut(lines: DataFrame, col: str = "value") -> DataFrame:
    """(word, vec) from lines 'word v1 ... vn'."""
    w = F.split(F.trim(col), " ")
    return lines.select(F.element_at(w, 1).alias("word"), F.transform(F.slice(w, 2, 1 << 20), lambda x: x.cast("float")).alias("vec"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest by squared L2 of each query row.

    The queries are a stated set, which every task holds with its k best rows of each, so the table isn't read for each block of them. Matrix
    products of ``block`` queries rule out rows that can't be among them; the others' distances are summed in order.
    Rows and queries that are no finite vectors of one length go by the expression itself.
    """
    spark = corpus.sparkSession
    asked = [(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]]) for r in queries.select("query_id", "query_vec").collect()]
    size = next((len(v) for _, v in asked if v), 0)
    plain = [v is not None and len(v) == size and all(x is not None and abs(x) < LARGEST for x in v) for _, v in asked]
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    fits = F.col("id").isNotNull() & (F.size("v") == size) & F.forall("v", lambda x: F.abs(x) < LARGEST)
    fits = F.coalesce(fits, F.lit(False))
    whole, odd = [q for q, fit in zip(asked, plain) if fit], [q for q, fit in zip(asked, plain) if not fit]
    schema = "query_id long, query_vec array<double>"
    by_row = lambda some, part: some.join(F.broadcast(spark.createDataFrame(part, schema))).select("query_id", "id", squared_l2(F.col("v"), F.col("query_vec")).alias("distance"))
    if not asked:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    best = rows.where(fits).mapInArrow(_nearest(spark.sparkContext.broadcast(whole), k, block), "query_id long, id long, distance double")
    best = best.unionByName(by_row(rows.where(~fits), whole)) if whole else best
    best = best.unionByName(by_row(rows, odd)) if odd else best
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.select("query_id", "id", "distance", rank.alias("rank")).where(F.col("rank") <= k)


def _nearest(asked, k: int, block: int):
    """The k nearest rows of a task for each query (query_id, vector) of a broadcast list, as (query_id, id, distance)."""

    def run(batches):
        if not asked.value:
            return
        names, q = np.array([n for n, _ in asked.value], np.int64), np.array([v for _, v in asked.value], float)
        q2 = (q * q).sum(1)
        near, ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column(0).to_numpy()
                x2 = (x * x).sum(1)
                for s in range(0, len(q), block):
                    y = q[s:s + block]
                    d = q2[s:s + block, None] + x2 - 2 * (y @ x.T)
                    slack = 1e-9 * (q2[s:s + block] + x2.max())  # far above what rounding takes
                    most = near[s:s + block, -1]
                    if len(x) > k and np.isinf(most).any():
                        most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
                    i, j = np.nonzero(d <= (most + slack)[:, None])
                    if not len(i):
                        continue
                    exact = np.zeros(len(i))
                    for c in range(x.shape[1]):
                        exact += (x[j, c] - y[i, c]) ** 2
                    hit = np.unique(i)
                    who = np.concatenate([i, np.repeat(hit, k)])
                    far, of = np.concatenate([exact, near[s + hit].ravel()]), np.concatenate([own[j], ids[s + hit].ravel()])
                    order = np.lexsort((of, far, who))
                    first = np.searchsorted(who[order], hit)
                    kept = order[first[:, None] + np.arange(k)]
                    near[s + hit], ids[s + hit] = far[kept], of[kept]
        i, j = np.nonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[i, j]), pa.array(near[i, j])], ["query_id", "id", "distance"])

    return run


def nearest_one(corpus: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance): exact k nearest of one vector. Tasks keep their best k; the driver's plan merges them."""
    asked = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.select(F.col(id_col).alias("id"), squared_l2(F.col(vec_col), asked).alias("distance")).orderBy("distance", "id").limit(k)


def merge_batches(batches: list[DataFrame], k: int) -> DataFrame:
    """The best k of several partial answers."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.orderBy("distance", "id").limit(k)


def cell_search(corpus: DataFrame, centers: list[list[float]], vector: list[float], k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Inverted-file search: only rows whose nearest centre is among the query's ``probes`` nearest."""
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    cell = F.array_min(F.transform(listed, lambda c, i: F.struct(squared_l2(F.col(vec_col), c).alias("d"), i.alias("i"))))["i"]
    order = np.argsort([sum((a - b) ** 2 for a, b in zip(c, vector)) for c in centers], kind="stable")[:probes]
    return nearest_one(corpus.where(cell.isin(*[int(i) for i in order])), vector, k, id_col, vec_col)


def rerank(found: DataFrame, query: str, by: str = "coverage", size: int = 100, stopwords=K.DETERMINERS) -> DataFrame:
    """Hits (id, distance, segment) by coverage of the query's subwords or by distance; ties keep the order of distance."""
    q, s = (F.array_distinct(T.subword_set(T.token_set(x, stopwords))) for x in (F.lit(query), T.clean_segment(F.col("segment"))))
    score = -F.col("distance") if by == "distance" else T.coverage(q, s)
    return found.withColumn("score", score).orderBy(F.desc("score"), "distance", "id").limit(size)


def word_weights(words: DataFrame, idf: DataFrame, stopwords=(), default: float = 0.0) -> DataFrame:
    """(word, weight): 0 for stop words, the idf of known ones, else the default."""
    known = idf.select(F.col("term").alias("word"), "idf")
    stop = F.col("word").isin(*stopwords) if stopwords else F.lit(False)
    return words.join(known, "word", "left").select("word", F.when(stop, 0.0).otherwise(F.coalesce("idf", F.lit(float(default)))).alias("weight"))


def left_out(word: Column, letters: int) -> Column:
    """A word with none to so many letters left out, each form once."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    forms = now = F.array(word)
    for _ in range(letters):
        now = F.array_distinct(F.flatten(F.transform(now, one)))
        forms = F.concat(forms, now)
    return F.array_distinct(forms)


def spell_corrected(words: DataFrame, vocabulary: DataFrame, edits: int = 2) -> DataFrame:
    """(word, corrected): the most frequent vocabulary word within so many edits; a word without a neighbour stays.

    Two words within so many edits become equal by leaving out at most so many letters of each, so words are joined on
    what is left of them, whichever letters differ, and then compared.
    """
    w = words.select("word").distinct()
    v = vocabulary.select(F.col("term").alias("v"), "df")
    keyed = lambda df, c: df.select("*", F.explode(left_out(F.col(c), edits)).alias("k"))
    near = keyed(w, "word").join(keyed(v, "v"), "k").select("word", "v", "df").distinct().where(F.levenshtein("word", "v", edits) >= 0)
    best = near.groupBy("word").agg(F.max_by("v", F.struct(F.col("df"), -F.levenshtein("word", "v"), "v")).alias("c"))
    return w.join(best, "word", "left").select("word", F.coalesce("c", "word").alias("corrected"))


def embed_texts(docs: DataFrame, lut: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: bool = True, unit: bool = True, size: int | None = None) -> DataFrame:
    """(id, vec): weighted sum of word vectors with repetition, of length one; zeros for a text without known words.

    Words are counted in the tasks that read the texts, joined with vectors and weights, and whole vectors are summed by
    text in the tasks before and after the shuffle: rows don't grow with the dimension and no vector table is collected.
    """
    size = size if size is not None else lut.select(F.max(F.size("vec"))).first()[0] or 0
    texts = docs.select(F.col(id_col).alias("id"), T.squeeze(F.lower(F.col(text_col))).alias("s")).where("s <> ''")
    tokens = texts.mapInArrow(_word_counts, f"id {texts.schema['id'].dataType.simpleString()}, word string, tf long")
    vec = normalized(F.col("vec")) if unit_words else F.col("vec")
    table = lut.join(weights, "word").where("weight <> 0").select("word", F.transform(vec, lambda x: x * F.col("weight")).alias("v"))
    tf = F.col("tf").cast("double")
    if 0 < size <= COLUMNS:
        sums = tokens.join(table, "word").groupBy("id").agg(*[F.sum(tf * F.col("v")[i]).alias(f"v{i}") for i in range(size)])
        rows = sums.select("id", F.array(*[f"v{i}" for i in range(size)]).alias("v"))
    else:
        rows = tokens.join(table, "word").groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("v"), tf)).alias("v"))
    zero = F.array_repeat(F.lit(0.0), size)
    out = docs.select(F.col(id_col).alias("id")).join(rows, "id", "left").select("id", F.coalesce("v", zero).alias("v"))
    return out.select("id", (normalized(F.col("v")) if unit else F.col("v")).alias("vec"))


def _word_counts(batches):
    """(id, word, tf) of each text (id, words between single spaces)."""
    for b in batches:
        split = pc.split_pattern(b.column(1), " ")
        size, coded = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
        many = len(coded.dictionary)
        both, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(), return_counts=True)
        for at in range(0, len(both), COUNTS):
            of, word = np.divmod(both[at:at + COUNTS], max(1, many))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), coded.dictionary.take(pa.array(word)), pa.array(tf[at:at + COUNTS].astype(np.int64))], ["id", "word", "tf"])


def segment_groups(rows: DataFrame, n: int, keys=("doc_id",), pos: str = "sent_id", text: str = "content") -> DataFrame:
    """(keys, member_ids, segment): n neighbouring segments with their places."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, n - 1)
    ids, parts = F.collect_list(pos).over(w), F.collect_list(text).over(w)
    return rows.select(*keys, ids.alias("member_ids"), F.concat(F.array_join(parts, ". "), F.lit(".")).alias("segment")).where(F.size("member_ids") == n)


def look_up_members(groups: DataFrame, members: DataFrame, group_id: str = "group_id", ids: str = "member_ids") -> DataFrame:
    """(group, parts): texts of a group's members in their order. ``members`` is (id, text)."""
    rows = groups.select(group_id, F.posexplode(ids).alias("p", "id")).join(members, "id")
    return rows.groupBy(group_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]).alias("parts"))


def by_positions(values: Column, places: Column) -> Column:
    """Values at places counted from 0."""
    return F.transform(places, lambda i: F.element_at(values, i + 1))


def similarity_pairs(vectors: DataFrame, block: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(block, i, j, sim) for i <= j within a block; the blocks' sizes are the caller's bound."""
    unit = normalized(F.col(vec_col))
    a = vectors.select(block.alias("block"), F.col(id_col).alias("i"), unit.alias("u"))
    b = a.select("block", F.col("i").alias("j"), F.col("u").alias("v"))
    return a.join(b, "block").where("i <= j").select("block", "i", "j", dot(F.col("u"), F.col("v")).alias("sim"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix in long form."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.select("i", "j", *rest).union(pairs.where("i <> j").select("j", "i", *rest))


def ladder(s: Column) -> Column:
    """Target of a row whose second-largest similarity is s."""
    out = F.when(s > 0.95, s)
    for above, target in K.SIMILARITY_LADDER:
        out = out.when(s > above, F.lit(target))
    return out.otherwise(F.lit(0.2))


def adjusted_similarity(matrix: DataFrame) -> DataFrame:
    """(i, j, sim): rows scaled so that their second-largest value meets the ladder, cut at 1, averaged with the transpose.

    Further columns of ``matrix`` are keys of matrices of their own and come first in the result.
    """
    keys = [c for c in matrix.columns if c not in ("i", "j", "sim")]
    second = F.element_at(F.sort_array(F.collect_list("sim"), asc=False), 2)
    rows = matrix.groupBy(*keys, "i").agg(second.alias("s"))
    factor = F.when((F.col("s") == 0) | F.col("s").isNull(), F.lit(0.0)).otherwise(F.try_divide(ladder(F.col("s")), F.col("s")))
    scaled = matrix.join(rows, [*keys, "i"]).select(*keys, "i", "j", F.least(F.lit(1.0), F.col("sim") * factor).alias("sim"))
    back = scaled.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col("sim").alias("t"))
    return scaled.join(back, [*keys, "i", "j"]).select(*keys, "i", "j", ((F.col("sim") + F.col("t")) / 2).alias("sim"))


def submatrix(matrix: DataFrame, left: list[str], right: list[str], missing: str = "not_embedded") -> DataFrame:
    """(p, q, i, j, sim) for two word lists, unknown words read from the row and column of ``missing``."""
    spark = matrix.sparkSession
    known = matrix.select("i").distinct()

    def side(words, pos, name):
        rows = spark.createDataFrame(list(enumerate(words)), f"{pos} int, w string")
        return rows.join(known, rows["w"] == known["i"], "left").select(pos, F.coalesce("i", F.lit(missing)).alias(name), F.lit(1).alias("one"))

    pairs = side(left, "p", "i").join(side(right, "q", "j"), "one").drop("one")
    return pairs.join(matrix, ["i", "j"], "left").select("p", "q", "i", "j", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.reduce(F.transform(F.array_intersect(a, b), lambda w: F.least(count(a, w), count(b, w))), F.lit(0), lambda s, x: s + x)


def aligned_similarity(n_a: Column, n_b: Column, common: Column, best_sum: Column, side: str = "short") -> Column:
    """Word-alignment similarity: the mean best word similarity of the chosen side, common words counted as one; 1 if
    either sentence is empty."""
    d = F.least(n_a, n_b) if side == "short" else F.greatest(n_a, n_b)
    mean = F.try_divide(best_sum, d)
    return F.when(F.least(n_a, n_b) == 0, F.lit(1.0)).otherwise(F.try_divide(mean * (d - common) + common, d))


def sentence_similarity(matrix: DataFrame, a: list[str], b: list[str], side: str = "short") -> float:
    """Similarity of two sentences from a word similarity matrix. One row comes back."""
    n_a, n_b = len(a), len(b)
    rows_of_a = n_a < n_b if side == "short" else n_a > n_b
    d_side = "p" if rows_of_a else "q"
    left = sum(min(a.count(w), b.count(w)) for w in set(a))
    if not min(n_a, n_b):
        return 1.0
    best = submatrix(matrix, a, b).groupBy(d_side).agg(F.max("sim").alias("m")).agg(F.sum("m")).first()[0]
    d = min(n_a, n_b) if side == "short" else max(n_a, n_b)
    return (best / d * (d - left) + left) / d


def projection_matrix(width: int, size: int, seed: int = 0, sparse: bool = True) -> np.ndarray:
    """(size, width) seeded random numbers: signs and zeros, or normal ones."""
    rng = np.random.default_rng(seed)
    if sparse:
        return rng.choice([-1.0, 0.0, 1.0], (size, width), p=[1 / 6, 2 / 3, 1 / 6]) * (3 / size) ** 0.5
    return rng.normal(0, size ** -0.5, (size, width))


def random_projection(df: DataFrame, size: int, vec_col: str = "embedding", seed: int = 0, sparse: bool = True) -> DataFrame:
    """Vectors projected by a seeded random matrix; kept as they are if they are no longer than ``size``.

    The matrix has dimension times size numbers, fixed by parameters, as literals in the plan.
    """
    width = df.select(F.max(F.size(vec_col))).first()[0] or 0
    if width <= size:
        return df
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in projection_matrix(width, size, seed, sparse)])
    return df.withColumn(vec_col, F.transform(rows, lambda r: dot(F.col(vec_col), r)))


def min_dimension(n: int, eps: float = 0.1) -> int:
    """Johnson-Lindenstrauss bound for n points."""
    return int(4 * np.log(n) / (eps ** 2 / 2 - eps ** 3 / 3))


def second_largest(xs: Column) -> Column:
    return F.element_at(F.sort_array(xs, asc=False), 2)


def compare_to_database(db: DataFrame, similarity: Callable[[Column], Column], col: str = "tokens") -> DataFrame:
    """Rows by similarity to a query, given as a function of the tokens column."""
    return db.withColumn("sim", similarity(F.col(col))).orderBy(F.desc("sim"))
