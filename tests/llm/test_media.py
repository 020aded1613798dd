import hashlib
import random
import zlib

import numpy as np
import pytest

from inkwell.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 6 * 64 * 9, 400_000])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    jpeg = media.encode(media.padded(data), n)
    pic = media.decode(jpeg)
    assert media.payload_of(pic) == media.padded(data) and pic.comment == b"n=%d" % n
    rgb = media.to_rgb(pic)
    assert rgb.dtype == np.uint8 and rgb.shape == (pic.height, pic.width, 3)


def test_several_rows_of_mcus(monkeypatch):
    monkeypatch.setattr(media, "ROW", 3)
    media.layout.cache_clear()
    data = bytes(range(256)) * 30
    assert media.payload_of(media.decode(media.encode(data))) == data
    media.layout.cache_clear()


def plain_scan(bits, coef, order, ss, se, ah, al, table):
    """A scan of one component by the standard's procedure, bit by bit."""
    run = 0
    for block in order:
        c, k = coef[block], ss
        if run:
            run -= 1
            if ah:
                for j in range(k, se + 1):
                    if c[j] and bits.take(1) and not abs(c[j]) >> al & 1:
                        c[j] += (1 << al) if c[j] > 0 else -(1 << al)
            continue
        while k <= se:
            x = bits.symbol(table)
            r, s = x >> 4, x & 15
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r) - 1
                if ah:
                    for j in range(k, se + 1):
                        if c[j] and bits.take(1) and not abs(c[j]) >> al & 1:
                            c[j] += (1 << al) if c[j] > 0 else -(1 << al)
                break
            if not ah:
                k += r
                if s:
                    c[k] = media._signed(bits.take(s), s) << al
                k += 1
                continue
            new = ((1 << al) if bits.take(1) else -(1 << al)) if s else 0
            while k <= se:
                if c[k]:
                    if bits.take(1) and not abs(c[k]) >> al & 1:
                        c[k] += (1 << al) if c[k] > 0 else -(1 << al)
                elif r == 0:
                    c[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1


class Writer:
    """Bits of a scan with a fixed eight-bit code for every symbol but 255."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def data(self):
        return np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes().replace(b"\xff", b"\xff\x00")


def written(coef, ss, se, ah, al):
    """A valid scan of coefficients (blocks, 64), runs of empty blocks taken together."""
    w, blocks = Writer(), coef.tolist()
    scaled = [[(abs(v) >> al) * (1 if v > 0 else -1) for v in b] for b in blocks]
    i = 0
    while i < len(blocks):
        new = [[k for k in range(ss, se + 1) if (abs(s[k]) == 1 if ah else s[k])] for s in scaled]
        empty = 0
        while i + empty < len(blocks) and not new[i + empty]:
            empty += 1
        if empty:
            r = empty.bit_length() - 1
            w.put(r << 4, 8), w.put(empty - (1 << r), r)
            for b in range(i, i + empty):
                for k in range(ss, se + 1):
                    if ah and abs(scaled[b][k]) > 1:
                        w.put(abs(scaled[b][k]) & 1, 1)
            i += empty
            continue
        k, s = ss, scaled[i]
        for at in new[i]:
            while True:
                zeros = [j for j in range(k, at) if (abs(s[j]) <= 1 if ah else not s[j])]
                cut = zeros[15] + 1 if len(zeros) > 15 else at
                if len(zeros) > 15:
                    w.put(0xF0, 8)
                    span = range(k, cut)
                else:
                    size = 1 if ah else abs(s[at]).bit_length()
                    w.put(len(zeros) << 4 | size, 8)
                    w.put(int(s[at] > 0) if ah else s[at] if s[at] > 0 else s[at] + (1 << size) - 1, 1 if ah else size)
                    span = range(k, at)
                if ah:
                    for j in span:
                        if abs(s[j]) > 1:
                            w.put(abs(s[j]) & 1, 1)
                k = cut
                if len(zeros) <= 15:
                    break
            k = at + 1
        if k <= se:
            w.put(0, 8)
            if ah:
                for j in range(k, se + 1):
                    if abs(s[j]) > 1:
                        w.put(abs(s[j]) & 1, 1)
        i += 1
    return w.data()


@pytest.mark.parametrize("seed", range(4))
def test_reader_on_other_streams(seed):
    """Sparse signed coefficients, runs of zeros, successive approximation: as by the standard's plain procedure."""
    rng = random.Random(seed)
    coef = np.zeros((50, 64), np.int64)
    for b in range(50):
        for _ in range(rng.choice((0, 0, 1, 5, 30))):
            coef[b, rng.randrange(1, 64)] = rng.choice((-1, 1)) * rng.choice((1, 2, 3, 7, 100))
    table = media.lookup(bytes([0] * 7 + [255] + [0] * 8), bytes(range(255)))
    fast, plain = np.zeros(50 * 63, np.int32), np.zeros((50, 64), np.int64)
    for ah, al in ((0, 2), (2, 1), (1, 0)):
        data = written(coef, 1, 63, ah, al)
        (media._ac_refine if ah else media._ac_first)(media.Bits(data), fast, 63, table, al)
        plain_scan(media.Bits(data), plain, range(50), 1, 63, ah, al, table[1])
        assert np.array_equal(fast.reshape(50, 63), plain[:, 1:])
    assert np.array_equal(plain[:, 1:], coef[:, 1:])


def test_inverse_transform():
    coef = np.random.default_rng(2).integers(-50, 50, (3, 64))
    n = np.arange(8)
    c = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, 8 ** -0.5, 0.5)
    for row in coef:
        f = np.zeros(64)
        f[media.ZIGZAG] = row
        assert np.allclose(row @ media.basis(), (c @ f.reshape(8, 8) @ c.T).ravel(), atol=1e-3)


def test_broken_streams():
    jpeg = media.encode(media.padded(b"hello" * 100))
    for bad in (b"", b"GIF89a", jpeg[:200], jpeg[:-400] + jpeg[-2:], jpeg.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError)):
            media.payload_of(media.decode(bad))


def test_query(spark, odd, none, documents):
    rows = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(40))
    want = sorted((str(i), len(b := (t or "").encode()), len(p := media.padded(b)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in rows.collect())
    got = media.media_digest(rows).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == want
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, r[5:]) == r[5:]
    assert media.media_digest(none).count() == 0
    back = media.read_media(media.store_texts(rows)).collect()
    shas = {(str(r.doc_id), r.rgb_sha256) for r in got}
    for r in back:  # the stored tensors, read back
        rgb = media.tensor(r.rgb, r.rgb_shape)
        assert np.array_equal(rgb, media.to_rgb(media.decode(r.media))) and (str(r.doc_id), hashlib.sha256(rgb.tobytes()).hexdigest()) in shas
    assert sorted(r.payload[:r.n_bytes] for r in back) == sorted((r.text or "").encode() for r in rows.collect())
