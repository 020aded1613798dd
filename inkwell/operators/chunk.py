"""Part-of-speech tags, chunk grammars and phrase extraction."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K

TAGGED = "array<struct<word:string,tag:string>>"
CHUNKS = "array<struct<label:string,leaves:array<struct<word:string,tag:string>>>>"
NOUNS = "array<struct<noun:string,alone:boolean,det:string,following:string>>"
#: Tags at which a noun phrase is divided, and of words that determine it.
CUTS, DETERMINERS = ("CC", "IN"), ("DT", "PRP$")

# The tag patterns.
VERBS = "<MD>*<RB.*>*<VB.*>+<JJ.*>*<VB.*>*<NN.*>*<IN>*<TO>?"
OLD_GRAMMARS = {"NP": "<DT>?<PRP\\$>?<CD>?<RB>*<JJ.*>*<NN.*>+", "VP": "<MD>*<RB.*>*<VB.*>+"}
#: A link of a chain of noun phrases; the first of a chain that must have a noun ends in + in place of *.
LINK = r"<PDT>?<DT>?<PRP\$>?<CD>?<VB.*>*?<DT>?<PRP\$>?<CD>?<RB>*<JJ.*>*<NN.*>*"
#: What stands before each link.
BEFORE = ("", "<CC>?", "<IN>?", "<CC>?", "<IN>?", "<CC>?", "<IN>?", "<CC>?")
PERHAPS_CHAIN = "".join(before + LINK for before in BEFORE)
CHAIN = LINK[:-1] + "+" + PERHAPS_CHAIN[len(LINK):]
GRAMMARS = {
    "NP": CHAIN, "VP": VERBS, "relation_VP": VERBS + "<RB.*>*<JJ.*>*",
    "SV": CHAIN + VERBS, "SV_O": CHAIN + VERBS + PERHAPS_CHAIN, "SVO": CHAIN + VERBS + CHAIN}

#: Small lexicon of the default tagger; other words go by their endings.
LEXICON = {
    "DT": "a an the this that these those every each some any no", "PRP": "i you he she it we they me him us them", "PRP$": "my your his her its our their",
    "IN": "of in on at by for with from as into about between during through over under after before since while because if than",
    "CC": "and or but nor yet", "TO": "to", "MD": "can could will would shall should may might must", "VBZ": "is has does", "VBP": "are am have do",
    "VBD": "was were had did", "VB": "be", "VBN": "been shown done", "VBG": "being", "RB": "not very also often then there here never always", "EX": "there",
    "WDT": "which", "WP": "who whom what", "WRB": "when where why how", "PDT": "all both half"}
WORD_TAGS = {w: t for t, ws in LEXICON.items() for w in ws.split()}
ENDINGS = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("ful", "JJ"), ("less", "JJ"), ("ies", "NNS"), ("s", "NNS"))
#: Endings by their last letter, in order.
ENDINGS_OF = {c: [x for x in ENDINGS if x[0][-1] == c] for c in {end[-1] for end, _ in ENDINGS}}
TOKEN = re.compile(r"\w+(?:[-'.]\w+)*|[^\w\s]")
NUMBER = re.compile(r"[\d.,%-]*\d[\d.,%-]*")
#: What stands for a tag while a sentence's tags are matched as a text.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

Tagger = Callable[[list[str]], list[str]]


def tokenize(text: str) -> list[str]:
    """Words with inner hyphens, apostrophes and points, and marks as tokens of their own."""
    return TOKEN.findall(text)


@lru_cache(maxsize=1 << 17)
def _tag_of(word: str, first: bool) -> str:
    low = word.lower()
    if low in WORD_TAGS:
        return WORD_TAGS[low]
    if not word.isalpha():
        if NUMBER.fullmatch(word):
            return "CD"
        if not re.search(r"\w", word):
            return word if word in ".,:" else ":"
    if word[0].isupper() and not first:
        return "NNP"
    if low.endswith("ss"):
        return "NN"
    return next((t for end, t in ENDINGS_OF.get(low[-1], ()) if low.endswith(end) and len(low) > len(end) + 2), "NN")


def rule_tagger(words: list[str]) -> list[str]:
    """Default tagger: lexicon, then shape and ending. Plainer than a trained one; any Tagger can take its place."""
    return [_tag_of(w, not i) for i, w in enumerate(words)]


def _lists(sizes: list[int], values: pa.Array, null=None) -> pa.ListArray:
    """Rows of so many values each, in order; null where ``null`` is true."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=None if null is None or not len(sizes) else pa.array(null, pa.bool_()))


def _tagged(rows: pa.Array, tagger: Tagger, tokenizer: Callable[[str], list[str]]) -> tuple[list[str], list[str], list[int], list[bool]]:
    """Words and tags of a batch, sentence after sentence, how many each has, and which are null."""
    words, tags, sizes, null = [], [], [], []
    for text in rows.to_pylist():
        own = tokenizer(text) if text is not None else []
        words += own
        tags += tagger(own)
        sizes.append(len(own))
        null.append(text is None)
    return words, tags, sizes, null


def tag(s: Column, tagger: Tagger = rule_tagger, tokenizer: Callable[[str], list[str]] = tokenize) -> Column:
    """Words of a sentence with their tags."""

    @F.arrow_udf(TAGGED)
    def run(rows: pa.Array) -> pa.Array:
        words, tags, sizes, null = _tagged(rows, tagger, tokenizer)
        both = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(tags, pa.string())], ["word", "tag"])
        return _lists(sizes, both, null)

    return run(s)


def tag_all(s: Column, taggers: dict[str, Tagger]) -> Column:
    """A struct with each tagger's result."""
    return F.struct(*[tag(s, t).alias(name) for name, t in taggers.items()])


def parse_tags(s: Column) -> Column:
    """'word/TAG word/TAG' as words with tags; the last slash counts."""
    parts = F.filter(F.split(s, r"\s+"), lambda w: w.rlike("/"))
    return F.transform(parts, lambda w: F.struct(F.regexp_extract(w, "^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(w, "^(.*)/([^/]*)$", 2).alias("tag")))


ITEM = re.compile(r"<([^<>]+)>([*+?]?)(\??)")


def compile_grammar(pattern: str) -> list[tuple[re.Pattern, int, bool, bool]]:
    """A tag pattern as items (tag, least, many, greedy). Patterns are sequences of <tag> with *, +, ? or lazy forms."""
    if ITEM.sub("", pattern):
        raise ValueError(f"not a sequence of tags: {ITEM.sub('', pattern)}")
    return [(re.compile(m[1]), int(m[2] in ("", "+")), m[2] in ("*", "+"), not m[3]) for m in ITEM.finditer(pattern)]


def _spans(tags: np.ndarray, names: list[str], sizes: np.ndarray, items) -> list[tuple[int, int]]:
    """Spans in many sentences at once: ``tags`` are numbers of ``names``, sentence after sentence, of ``sizes``.

    For each item, from the last, it is found for all places together where the rest of the pattern would end, in the
    order of preference of a backtracking matcher: how far an item can reach, and which of those places the rest can
    follow. So time is bounded by items times tags, whatever the pattern.
    """
    n, rows = len(tags), len(sizes)
    place = np.arange(n) + np.repeat(np.arange(rows), sizes)  # each sentence has one place more than tags
    size = n + rows
    tag = np.full(size, len(names))
    tag[place] = tags
    at = np.arange(size)
    ends = at.copy()
    for regex, least, many, greedy in reversed(items):
        fits = np.array([bool(regex.fullmatch(x)) for x in names] + [False])[tag]
        if many:
            stop = np.minimum.accumulate(np.where(fits, size, at)[::-1])[::-1]  # the first place that doesn't fit
        else:
            stop = at + fits
        if greedy:
            found = np.maximum.accumulate(np.where(ends >= 0, at, -1))[stop]
            good = found >= at + least
        else:
            following = np.append(np.minimum.accumulate(np.where(ends >= 0, at, size)[::-1])[::-1], size)
            found = following[np.minimum(at + least, size)]
            good = (found <= stop) & (at + least <= stop)
        ends = np.where(good, ends[np.where(good, found, 0)], -1)
    begins = np.append(np.minimum.accumulate(np.where(ends > at, at, size)[::-1])[::-1], size).tolist()
    back = np.cumsum(np.bincount(place, minlength=size)).tolist() if size else []  # tags up to and with each place
    ends, out, i = ends.tolist(), [], begins[0]
    while i < size:
        out.append((back[i] - 1, back[ends[i] - 1]))
        i = begins[ends[i]]
    return out


def _pattern(names: list[str], items) -> str | None:
    """The items as a pattern of LETTERS, one for each of ``names``; none if no tag meets an item that must be there."""
    parts = []
    for regex, least, many, greedy in items:
        own = "".join(c for c, x in zip(LETTERS, names) if regex.fullmatch(x))
        if own:
            parts.append(f"[{own}]" + ("+" if least and many else "*" if many else "" if least else "?") + ("" if greedy else "?"))
        elif least:
            return None
    return "".join(parts)


def _matches(tags: pa.Array, sizes, items) -> np.ndarray:
    """Rows (begin, end) of ``_spans``, from one text for each sentence with a letter for each tag, by Arrow's matcher:
    its preferences are those of a backtracking one, its time grows with the tags only."""
    coded = tags.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if len(names) > len(LETTERS) or not any(least for _, least, _, _ in items):  # one that may be empty is matched otherwise
        return np.array(_spans(code.astype(np.int64), names, np.asarray(sizes, np.int64), items), np.int64).reshape(-1, 2)
    pattern = _pattern(names, items)
    if pattern is None:
        return np.zeros((0, 2), np.int64)
    letters, ends = np.frombuffer(LETTERS.encode(), np.uint8)[code], np.append(0, np.cumsum(sizes)).astype(np.int32)
    marked = pc.replace_substring_regex(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters)), pattern, r"<\0>")
    flat = np.frombuffer("".join(marked.to_pylist()).encode(), np.uint8)
    begin, end = flat == ord("<"), flat == ord(">")
    upto = np.cumsum(~(begin | end))
    return np.stack([upto[begin], upto[end]], 1)


def chunk_spans(tags: list[str], items: list[tuple[re.Pattern, int, bool, bool]]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping spans of one sentence in the order of preference of a backtracking matcher."""
    return [tuple(x) for x in _matches(pa.array(tags, pa.string()), [len(tags)], items).tolist()]


def _parts(rows: pa.Array):
    """Rows of a list column: their sizes, flattened values and which rows are null."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, rows.flatten(), rows.is_null().to_numpy(zero_copy_only=False)


def chunk(tagged: Column, label: str = "NP", grammar: str | None = None) -> Column:
    """One-level parse: chunks of the pattern under its label, every other word under 'O', in order.

    A batch's sentences are matched together, and the chunks are cuts of the same words: nothing is copied.
    """
    items = compile_grammar(grammar or GRAMMARS[label])

    @F.arrow_udf(CHUNKS)
    def run(rows: pa.Array) -> pa.Array:
        sizes, words, null = _parts(rows)
        n, inside, first = len(words), np.zeros(len(words), bool), np.ones(len(words), bool)
        if n:
            spans = _matches(words.field("tag"), sizes, items)
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, spans[:, 0], 1)
            np.add.at(depth, spans[:, 1], -1)
            inside = np.cumsum(depth)[:-1] > 0
            first = ~inside
            first[spans[:, 0]] = True
        begins = np.flatnonzero(first)
        leaves = _lists(np.diff(np.append(begins, n)).tolist(), words)
        labels = pa.array(np.where(inside[begins], label, "O"), pa.string())
        owner = np.repeat(np.arange(len(sizes)), sizes)[begins] if n else begins
        return _lists(np.bincount(owner, minlength=len(sizes)).tolist(), pa.StructArray.from_arrays([labels, leaves], ["label", "leaves"]), null)

    return run(tagged)


def extract(chunks: Column, label: str, join_neighbours: bool = False) -> Column:
    """Leaves of the label's chunks. A chunk that ends in a verb pattern loses a last adjective before a noun; with
    ``join_neighbours`` chunks next to each other become one."""
    verbal = label in ("VP", "SV", "relation_VP")

    @F.arrow_udf(f"array<{TAGGED}>")
    def run(rows: pa.Array) -> pa.Array:
        sizes, parts, null = _parts(rows)
        if not len(parts):
            return _lists(sizes.tolist(), pa.array([], pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))), null)
        leaves = parts.field("leaves")
        n = pc.list_value_length(leaves).to_numpy(zero_copy_only=False).astype(np.int64)
        words = leaves.flatten()
        owner, stop = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(n)
        own = pc.equal(parts.field("label"), label).to_numpy(zero_copy_only=False)
        begin, end = stop - n, stop.copy()
        if verbal:
            tags = words.field("tag")
            noun, adjective = (pc.starts_with(tags, x).to_numpy(zero_copy_only=False) for x in ("NN", "JJ"))
            before = np.append(owner[1:] == owner[:-1], False)
            cut = own & before & noun[np.minimum(stop, len(words) - 1)] & adjective[stop - 1]
            end[cut] -= 1
        mine = np.flatnonzero(own)
        new = np.ones(len(mine), bool)
        if join_neighbours:
            new[1:] = (np.diff(mine) > 1) | (np.diff(owner[mine]) > 0)
        kept = (end - begin)[mine]
        at = np.append(0, np.cumsum(kept)[:-1]) if len(mine) else mine
        take = np.repeat(begin[mine] - at, kept) + np.arange(kept.sum())
        phrases = _lists(np.add.reduceat(kept, np.flatnonzero(new)).tolist() if len(mine) else [], words.take(pa.array(take)))
        return _lists(np.bincount(owner[mine[new]], minlength=len(sizes)).tolist(), phrases, null)

    return run(chunks)


def count_phrases(s: Column, labels=("NP", "VP"), tagger: Tagger = rule_tagger, tokenizer: Callable[[str], list[str]] = tokenize) -> Column:
    """How many phrases of each label a sentence has, chunks next to each other as one: the sizes of ``extract`` with
    ``join_neighbours``, without words and tags leaving the task's batch."""
    grammars = [compile_grammar(GRAMMARS[x]) for x in labels]

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        _, tags, sizes, null = _tagged(rows, tagger, tokenizer)
        tags, stop, counts = pa.array(tags, pa.string()), np.cumsum(sizes), []
        for items in grammars:
            spans = _matches(tags, sizes, items)
            owner = np.searchsorted(stop, spans[:, 0], "right")
            new = np.append(True, (spans[1:, 0] != spans[:-1, 1]) | (owner[1:] != owner[:-1]))[:len(spans)]
            counts.append(np.bincount(owner[new], minlength=len(sizes)))
        return _lists([len(labels)] * len(sizes), pa.array(np.stack(counts, 1).ravel().astype(np.int32)), null)

    return run(s)


def noun_parts(s: Column, tagger: Tagger = rule_tagger, tokenizer: Callable[[str], list[str]] = tokenize) -> Column:
    """Parts of a sentence's noun phrases: the noun, whether a determiner alone, and the first determiner before another
    word with that word. As ``divide_noun_phrase`` and ``noun_of`` of each NP chunk tell, without words and tags leaving
    the task's batch."""
    items = compile_grammar(GRAMMARS["NP"])

    @F.arrow_udf(NOUNS)
    def run(rows: pa.Array) -> pa.Array:
        words, tags, sizes, null = _tagged(rows, tagger, tokenizer)
        spans = _matches(pa.array(tags, pa.string()), sizes, items)
        owner, found, alone, dets, following = [], [], [], [], []
        for (begin, end), of in zip(spans.tolist(), np.searchsorted(np.cumsum(sizes), spans[:, 0], "right").tolist()):
            cuts = [i for i in range(begin, end) if tags[i] in CUTS]
            for a, b in zip([begin, *[i + 1 for i in cuts]], [*cuts, end]):
                if a == b:
                    continue
                i, noun = b - 1, words[b - 1].strip(" ")
                while i > a and tags[i - 1][:2] in ("NN", "JJ"):
                    i -= 1
                    noun = f"{words[i]} {noun}".strip(" ")
                at = next((k for k in range(a, b - 1) if tags[k] in DETERMINERS), None)
                owner.append(of)
                found.append(noun)
                alone.append(b - a == 1 and tags[a] == "DT")
                dets.append(None if at is None else words[at])
                following.append(None if at is None else words[at + 1])
        parts = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(alone, pa.bool_()), pa.array(dets, pa.string()), pa.array(following, pa.string())], ["noun", "alone", "det", "following"])
        return _lists(np.bincount(np.array(owner, np.int64), minlength=len(sizes)).tolist(), parts, null)

    return run(s)


def remove_subject(chunks: Column, placeholder: bool = True) -> Column:
    """Words of a sentence chunked by SV: within a chunk only verbs and modals stay, the first other word as a mark."""

    def leaves(x):
        verb = lambda w: F.substring(w["tag"], 1, 2).isin("VB", "MD")
        first = F.array_position(F.transform(x["leaves"], lambda w: ~verb(w)), F.lit(True))
        kept = F.transform(x["leaves"], lambda w, i: F.when(verb(w), w["word"]).when((i + 1 == first) & F.lit(placeholder), F.lit(K.SUBJECT_MARK)).otherwise(F.lit("")))
        return F.when(x["label"] == "SV", kept).otherwise(F.transform(x["leaves"], lambda w: w["word"]))

    return F.filter(F.flatten(F.transform(chunks, leaves)), lambda w: w != "")


def divide_noun_phrase(leaves: Column) -> Column:
    """Parts of a noun phrase between conjunctions and prepositions."""
    kind = "array<array<struct<word:string,tag:string>>>"
    last = lambda a: F.slice(a, F.size(a), 1)[0]
    cut = lambda w: w["tag"].isin("CC", "IN")
    step = lambda a, w: F.when(cut(w), F.concat(a, F.array(F.array()).cast(kind))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), F.array(w)))))
    return F.filter(F.reduce(leaves, F.array(F.array()).cast(kind), step), lambda p: F.size(p) > 0)


def noun_of(part: Column) -> Column:
    """The last word with the nouns and adjectives right before it."""
    back = F.reverse(part)
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"), F.lit("").alias("noun"))

    def step(a, w):
        take = a["on"] & ((a["n"] == 0) | F.substring(w["tag"], 1, 2).isin("NN", "JJ"))
        return F.struct(take.alias("on"), (a["n"] + 1).alias("n"), F.when(take, F.trim(F.concat(w["word"], F.lit(" "), a["noun"]))).otherwise(a["noun"]).alias("noun"))

    return F.reduce(back, start, step, lambda a: a["noun"])


def noun_verb_runs(tagged: Column) -> Column:
    """Runs of nouns, and of verbs with the prepositions after them, as phrases. The run that ends the sentence is left out."""
    kind = "struct<kind:string,words:array<string>,out:array<string>>"

    def step(a, w):
        short = F.substring(w["tag"], 1, 2)
        now = F.when(short == "NN", F.lit("N")).when(short == "VB", F.lit("V")).when(w["tag"].isin("IN", "TO") & (a["kind"] == "V"), F.lit("V")).otherwise(F.lit(""))
        same = (now == a["kind"]) & (now != "")
        flushed = F.when((F.size(a["words"]) > 0) & ~same, F.concat(a["out"], F.array(F.array_join(a["words"], " ")))).otherwise(a["out"])
        words = F.when(same, F.concat(a["words"], F.array(w["word"]))).when(now != "", F.array(w["word"])).otherwise(F.array().cast("array<string>"))
        return F.struct(now.alias("kind"), words.alias("words"), flushed.alias("out")).cast(kind)

    return F.reduce(tagged, F.struct(F.lit("").alias("kind"), F.array().alias("words"), F.array().alias("out")).cast(kind), step, lambda a: a["out"])


def phrase_modes(phrases: Column, mode: str) -> Column:
    """``fpo`` the first phrase only, ``cp`` all as one, ``asp`` each apart. Phrases are arrays of words."""
    if mode == "fpo":
        return F.slice(phrases, 1, 1)
    if mode == "cp":
        return F.when(F.size(phrases) > 0, F.array(F.flatten(phrases))).otherwise(phrases)
    if mode == "asp":
        return phrases
    raise ValueError("mode is fpo, cp or asp")
