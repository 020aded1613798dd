"""Byte-level pair encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import slices, tidy

#: How the byte-level family cuts a text before it merges, with letters and numbers to be filled in.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{other}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids by a worker, twice at most, and the characters of the longest one kept.
MEMO, MEMO_CHARS = 1 << 18, 48
#: Checked pairs of tokens kept by a worker, twice at most.
PAIRS = 1 << 18
#: Ids decoded at once.
STEP = 1 << 16


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def newer_letters() -> list[int]:
    """Letters, numbers and white space that only ``regex`` knows, as code points.

    Its tables follow a later Unicode than the library's splitter, which takes these for marks. Asked are characters
    that Python's own, older tables don't know.
    """
    known, cut = regex.compile(r"[\p{L}\p{N}\s]"), ByteLevel(add_prefix_space=False).pre_tokenize_str
    newer = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    return [c for c in newer if len(cut(f"!{chr(c)}")) == 1]


def char_class(points: list[int]) -> str:
    """Sorted code points as ranges of a character class."""
    out, start = [], 0
    for i, c in enumerate(points):
        if i + 1 == len(points) or points[i + 1] != c + 1:
            out.append(f"\\U{points[start]:08x}-\\U{c:08x}")
            start = i + 1
    return "".join(out)


@dataclass
class Vocabulary:
    """A byte-level vocabulary as tables; its size bounds all of them.

    ``data`` holds the bytes of all tokens, token i from ``offset[i]`` to ``offset[i + 1]``. ``rank`` is the order in
    which a token was merged, -1 for single bytes; ``left`` and ``right`` are the two tokens it was merged of.
    """

    data: bytes
    offset: np.ndarray
    rank: list[int]
    left: list[int]
    right: list[int]
    special: dict[str, int]
    key: str = ""
    late: list[int] = field(default_factory=newer_letters)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizer file. One of another kind than byte-level pair encoding without prefix space is refused."""
        with open(path, "rb") as f:
            file = f.read()
        all_ = json.loads(file)
        model, cut = all_["model"], all_["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or all_["normalizer"] or model.get("dropout") or model.get("byte_fallback") \
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level vocabulary")
        added = all_["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions")
        of_letter = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in added}
        size = max(chain(model["vocab"].values(), special.values())) + 1
        text = [b""] * size
        for token, i in model["vocab"].items():
            text[i] = b"".join(of_letter[c] for c in token)
        for token, i in special.items():
            text[i] = token.encode()
        rank, left, right = [-1] * size, [-1] * size, [-1] * size
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = model["vocab"][a + b]
            if rank[i] < 0:
                rank[i], left[i], right[i] = r, model["vocab"][a], model["vocab"][b]
        return cls(b"".join(text), np.cumsum([0, *map(len, text)]), rank, left, right, special, hashlib.sha256(file).hexdigest())

    def token(self, i: int) -> bytes:
        return self.data[self.offset[i]:self.offset[i + 1]]


class _Memo(dict):
    """Values worked out when first asked for. Of two generations the older goes when the younger has ``most``; what is
    asked for in the older one moves to the younger, so common keys stay."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Encodes whole texts with one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = v = vocab
        plain = set(range(len(v.rank))) - set(v.special.values())
        self.size = np.diff(v.offset).tolist()
        self.matches = ahocorasick.Automaton()
        by_text = {}
        for i in plain:
            if self.size[i]:
                by_text[v.token(i).decode("latin-1")] = i
        for text, i in by_text.items():
            self.matches.add_word(text, (len(text) - 1, i))
        self.matches.make_automaton()
        #: Longest token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * len(v.rank)
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in by_text), -1)
        self.merge = {(v.left[i], v.right[i]): v.rank[i] for i in plain if v.rank[i] >= 0}
        #: Pair-compatibility table: by one token times 2**32 plus another, the longest prefix of the other that fits after the one, or -1.
        self.fitting = _Memo(lambda pair: self.fit(pair >> 32, pair & 0xFFFFFFFF), PAIRS)
        self.ids = _Memo(self.piece, MEMO, MEMO_CHARS)
        self.cut_ascii = re.compile(PIECES.format(letter="[A-Za-z]", number="[0-9]", other="A-Za-z0-9"), re.ASCII)
        self.cut = regex.compile(PIECES.format(letter=r"\p{L}", number=r"\p{N}", other=r"\p{L}\p{N}"))
        # newer letters are marks to the vocabulary's splitter
        self.late, late = frozenset(map(chr, v.late)), char_class(v.late)
        self.cut_late = regex.compile(PIECES.format(letter=rf"(?:(?![{late}])\p{{L}})", number=rf"(?:(?![{late}])\p{{N}})", other="").replace(r"[^\s]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])") if late else r"\Z.")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens side by side gives these two tokens.

        The merges are undone from the last one back, on whichever side made it. While two tokens stand at the border,
        their own merge must not come earlier than the one undone next above them: of equal merges the left one goes first.
        """
        rank, before = self.vocab.rank, sys.maxsize
        while True:
            if self.merge.get((a, b), before) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.vocab.right[a]
            else:
                before, b = rank[b] + 1, self.vocab.left[b]

    def fit(self, last: int, token: int) -> int:
        while token >= 0 and not self.compatible(last, token):
            token = self.shorter[token]
        return token

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, four bytes each.

        Tokens are tried from the longest match down; a token stays if it fits the one before. A place from which
        nothing fits is marked and never tried again, so that each place is left at most once.
        """
        text = piece.encode().decode("latin-1")
        n, size, shorter, fitting = len(text), self.size, self.shorter, self.fitting
        longest = [-1] * n
        for end, (before, i) in self.matches.iter(text):
            longest[end - before] = i  # later ends are longer
        if size[longest[0]] == n:
            return longest[0].to_bytes(4, sys.byteorder)
        dead, token = bytearray(n + 1), longest[0]
        out, at = [token], size[token]
        token = longest[at]
        while True:
            if out:
                token = fitting[out[-1] << 32 | token] if token >= 0 else -1
            while token >= 0 and dead[at + size[token]]:
                token = shorter[token]
                if out and token >= 0:
                    token = fitting[out[-1] << 32 | token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    break
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return array("i", out).tobytes()

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.cut_ascii.findall(text)
        if self.late.isdisjoint(text if len(text) < 64 else set(text)):
            return self.cut.findall(text)
        return self.cut_late.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. The strings of special tokens are those tokens."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.vocab.special) else [text]
        ids = self.ids.__getitem__
        found = [b"".join(map(ids, self.pieces(part))) if not k % 2 else self.vocab.special[part].to_bytes(4, sys.byteorder) for k, part in enumerate(parts)]
        return np.frombuffer(b"".join(found), np.int32)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids: their bytes by the offset table, STEP ids at once; bytes that aren't UTF-8 become U+FFFD."""
    data, out = np.frombuffer(vocab.data, np.uint8), []
    ids = ids[ids < len(vocab.rank)]
    for k in range(0, len(ids), STEP):
        part = ids[k:k + STEP]
        size = vocab.offset[part + 1] - vocab.offset[part]
        ends = np.cumsum(size)
        out.append(data[np.arange(ends[-1]) + np.repeat(vocab.offset[part] - ends + size, size)].tobytes())
    return b"".join(out).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocab: Vocabulary) -> Encoder:
    """One encoder for a worker, which is kept for later tasks."""
    if vocab.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocab.key] = Encoder(vocab)
    return _ENCODERS[vocab.key]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_vocabulary(spark: SparkSession, path: str | None = None):
    """A vocabulary read on the driver and broadcast; its tables are as large as the vocabulary, whatever the texts."""
    return spark.sparkContext.broadcast(Vocabulary.load(path or vocabulary_path()))


def encode(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the vocabulary's own library encodes it.

    Null and empty texts have no ids. Repeated rows stay, a null id stays null; an empty table gives an empty table;
    other columns are ignored. A very long text is encoded in one task, in time linear in its length and memory of about
    forty times its longest piece.
    """

    def run(batches):
        enc = _encoder(shared.value)
        for b in slices(batches, 256):
            ids = [enc.encode(t) if t else np.zeros(0, np.int32) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, shared, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """The rows with the text of their ids in place of the ids; special tokens are written out.

    Null ids, and null or unknown ones among them, give nothing. Bytes that aren't UTF-8 become U+FFFD. A column named
    like ``into`` is replaced.
    """
    keep = [c for c in rows.columns if c.lower() not in (ids_col.lower(), into.lower())]
    src = rows.select(*[F.col(f"`{c}`") for c in keep], F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0)).alias("ids"))

    def run(batches):
        v = shared.value
        for b in slices(batches, 256):
            ids = b.column(b.num_columns - 1)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *ids.value_lengths().to_numpy(zero_copy_only=False)])
            texts = [decode_ids(v, flat[i:j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(tidy(run), f"{kinds}, `{into}` string" if keep else f"`{into}` string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again from its ids."""
    shared = shared_vocabulary(docs.sparkSession, path)
    found = encode(docs, shared).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode(found, shared).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
