"""Pair encoding against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import pytest

from inkwell.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(bpe.vocabulary_path()))


def test_mixed_texts(library, encoder):
    rng = random.Random(1)
    parts = ["a", "b", "aa", " ", "  ", "\n", "the", "é", "漢", "😀", "<|endoftext|>", "<|endoftext", "1", "23", "'s", "'S", "'", "՘", "\U0001e6c0", "\x1c", "\x85", "　", "\x00", "�", "ing", "token", "ization", "____", "----", "0000"]
    for _ in range(8000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert encoder.encode(s).tolist() == ids, s
        assert bpe.decode_ids(encoder.vocab, np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_every_token_and_long_pieces(library, encoder):
    texts = [library.decode([i]) for i in range(0, 50_256)]
    texts = [t for t in texts if "�" not in t] + ["a" * 30_000 + "b", "-=" * 9_000, "".join(random.Random(2).choice("abcdefgh") for _ in range(30_000))]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(t).tolist() == want.ids


def test_all_characters_are_cut_alike(library, encoder):
    cut = library.pre_tokenizer.pre_tokenize_str
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}"
            assert encoder.pieces(s) == [s[i:j] for _, (i, j) in cut(s)], hex(c)


def test_pairs_are_compatible_if_the_library_keeps_them(library, encoder):
    rng = random.Random(4)
    v = encoder.vocab
    words = [i for i in range(50_256) if v.token(i).isalpha() and v.token(i).isascii()]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        assert encoder.compatible(a, b) == (library.encode((v.token(a) + v.token(b)).decode(), add_special_tokens=False).ids == [a, b])


def test_bytes_that_are_not_utf8(library, encoder):
    ids = np.array([i for i in range(256)] + [50_256], np.int32)
    assert bpe.decode_ids(encoder.vocab, ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_small_memory_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    monkeypatch.setattr(bpe, "STEP", 5)
    enc = bpe.Encoder(bpe.Vocabulary.load(bpe.vocabulary_path()))
    text = "some words and some other words come back in some order " * 3
    assert enc.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids and bpe.decode_ids(enc.vocab, enc.encode(text)) == text
    assert len(enc.ids) <= 3 and len(enc.fitting) <= 2


def plain(library, rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [e.ids for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    return [(r.doc_id, len(i), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids)]


def test_query_is_the_library_on_the_whole_table(spark, sf, documents, library):
    assert sorted(map(tuple, queries.queries()["op13_bpe"](spark, sf).collect())) == sorted(plain(library, documents.collect()))


def test_odd_rows(spark, odd, none, library):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe.digest(odd).collect()), key=key) == sorted(plain(library, odd.collect()), key=key)
    assert bpe.digest(none).count() == 0


def test_decode_keeps_other_columns(spark):
    shared = bpe.shared_vocabulary(spark)
    df = spark.createDataFrame([(1, [1544, 99, -1, None, 10**6], "old", 2.0), (2, None, "x", None), (3, [], "y", 0.0)], "doc_id long, ids array<int>, text string, score double")
    got = {r.doc_id: (r.text, r.score) for r in bpe.decode(df, shared).collect()}
    v = shared.value
    assert got == {1: ((v.token(1544) + v.token(99)).decode("utf-8", "replace"), 2.0), 2: ("", None), 3: ("", 0.0)}


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(bpe.vocabulary_path("word_bpe_49k.json"))
