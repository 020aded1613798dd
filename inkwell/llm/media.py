"""Media columns: payloads as progressive JPEG coefficients, read back scan by scan into RGB tensors."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampling factors of Y, Cb and Cr: chroma has half the rows and columns.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: A payload byte is the coefficient byte + OFFSET, so every stored coefficient has nine bits and none is zero.
OFFSET = 256
#: Bits of a coefficient that are left to refinement scans.
LOW = 2
#: Spectral bands of the first AC scans.
BANDS = ((1, 5), (6, 63))
#: MCUs in a row at most: an image is a strip of this many, or several rows of them.
ROW = 4095
MAX_EOBRUN = 32767
#: Bytes of tensors in a record batch, about.
PART_BYTES = 16 << 20

#: Fixed values of the JPEG standard: the zigzag order, row by row.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])

#: Huffman tables as (codes of each length 1..16, symbols). DC: twelve sizes of 4 bits. AC: "no zeros, 7 bits" in one
#: bit, end-of-block runs in five.
DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
AC_TABLE = (bytes([1, 0, 0, 0, 15] + [0] * 11), bytes([0x07, *(r << 4 for r in range(15))]))

NEXT_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, list[int]]:
    """length << 8 | symbol for every 16 bits that begin with a code; 0 where none does."""
    out, code, i = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[i:i + n]:
            out[code << 16 - length:code + 1 << 16 - length] = length << 8 | s
            code += 1
        i, code = i + n, code << 1
    return out, out.tolist()


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples) inverse DCT."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, 8 ** -0.5, 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(parts: tuple[int, ...], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _eob_bits(run: int) -> np.ndarray:
    """Bits of an end-of-block run: its code, then the bits below the leading one."""
    r = run.bit_length() - 1
    text = f"{16 + r:05b}" + (f"{run - (1 << r):0{r}b}" if r else "")
    return np.frombuffer(text.encode(), np.uint8) - 48


def _mcu_order(h: int, v: int, wide: int, high: int) -> np.ndarray:
    """Blocks of a component, numbered row by row, in the order of an interleaved scan: (MCUs, h * v)."""
    return np.arange(wide * h * high * v).reshape(high, v, wide, h).transpose(0, 2, 1, 3).reshape(-1, h * v)


@lru_cache(maxsize=256)
def layout(blocks: int) -> tuple[int, int, tuple[int, ...], np.ndarray]:
    """MCU columns and rows for so many blocks, blocks of each component, and all blocks in interleaved order."""
    mcus = max(1, -(-blocks // 6))
    wide = min(mcus, ROW)
    high = -(-mcus // wide)
    sizes = tuple(h * v * wide * high for h, v in SAMPLING)
    starts = np.cumsum((0, *sizes[:-1]))
    order = np.hstack([_mcu_order(h, v, wide, high) + s for (h, v), s in zip(SAMPLING, starts)])
    return wide, high, sizes, order


def encode(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A payload of a multiple of 64 bytes as a progressive JPEG; each byte is one coefficient.

    Scans: DC without its lowest bit, that bit, then for each component two bands of AC coefficients without their
    LOW lowest bits, and one scan for each of these. Blocks beyond the payload are zero. A comment holds ``n_bytes``.
    """
    if len(payload) % 64 or not payload:
        raise ValueError("the payload is a positive multiple of 64 bytes")
    full = len(payload) // 64
    wide, high, sizes, order = layout(full)
    total = sum(sizes)
    coef = np.zeros((total, 64), np.int16)
    coef[:full] = np.frombuffer(payload, np.uint8).reshape(full, 64)
    coef[:full] += OFFSET
    frame = b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03" + b"".join(
        bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
    out = [b"\xff\xd8", _segment(0xFE, b"n=%d" % (len(payload) if n_bytes is None else n_bytes)), _segment(0xDB, b"\x00" + b"\x01" * 64),
           _segment(0xC2, frame), _segment(0xC4, b"\x00" + b"".join(DC_TABLE) + b"\x10" + b"".join(AC_TABLE))]
    dc = coef[:, 0][order].astype(np.int64)
    high_dc = dc >> 1
    step, at = np.empty_like(high_dc), 0
    for h, v in SAMPLING:
        own = high_dc[:, at:at + h * v].ravel()
        step[:, at:at + h * v] = np.diff(own, prepend=0).reshape(-1, h * v)
        at += h * v
    step = step.ravel()
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int64)
    word, length = size << size | np.where(step < 0, step + (1 << size) - 1, step), size + 4
    place = np.arange(16)
    bits = (word[:, None] >> (length[:, None] - 1 - place).clip(0)) & 1
    out.append(_scan((0, 1, 2), 0, 0, 0, 1, _pack(bits[place < length[:, None]].astype(np.uint8))))
    out.append(_scan((0, 1, 2), 0, 0, 1, 0, _pack((dc & 1).astype(np.uint8).ravel())))
    start = 0
    for c, n in enumerate(sizes):
        held = max(0, min(n, full - start))
        own = coef[start:start + held]
        empty = [_eob_bits(min(MAX_EOBRUN, n - i)) for i in range(held, n, MAX_EOBRUN)]
        tail = _pack(np.concatenate(empty)) if empty else b""
        upper = (own >> LOW).astype(np.uint8)
        for ss, se in BANDS:
            out.append(_scan((c,), ss, se, 0, LOW, upper[:, ss:se + 1].tobytes() + tail))
        for al in range(LOW - 1, -1, -1):
            low = (own[:, 1:] >> al & 1).astype(np.uint8)
            parts = [x for i in range(0, n, MAX_EOBRUN) for x in (_eob_bits(min(MAX_EOBRUN, n - i)), low[i:i + MAX_EOBRUN].ravel())]
            out.append(_scan((c,), 1, 63, al + 1, al, _pack(np.concatenate(parts))))
        start += n
    out.append(b"\xff\xd9")
    return b"".join(out)


# Reading


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row and rows, with those that fill up the last MCUs
    high: int = 0
    coef: np.ndarray = field(default=None, repr=False)  # (high * wide, 64), zigzag


@dataclass
class Picture:
    """Coefficient arrays of a progressive JPEG."""

    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class Bits:
    """Entropy-coded bytes of one scan, without stuffing, and a bit position."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.end = 8 * (len(self.data) - 8)
        self.pos = 0
        self._array = None

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = np.frombuffer(self.data, np.uint8)
        return self._array

    def peek16(self) -> int:
        i = self.pos >> 3
        return int.from_bytes(self.data[i:i + 3], "big") >> 8 - (self.pos & 7) & 0xFFFF

    def take(self, n: int) -> int:
        if self.pos + n > self.end:
            raise ValueError("the scan ends too soon")
        i, self.pos = self.pos, self.pos + n
        b = self.data[i >> 3:(i + n + 7) >> 3]
        return int.from_bytes(b, "big") >> -(i + n) % 8 & (1 << n) - 1

    def symbol(self, table: list[int]) -> int:
        x = table[self.peek16()]
        if not x or self.pos + (x >> 8) > self.end:
            raise ValueError("no such code")
        self.pos += x >> 8
        return x & 255

    def run(self, n: int) -> np.ndarray:
        """The next n bits as 0 and 1."""
        if self.pos + n > self.end:
            raise ValueError("the scan ends too soon")
        i, self.pos = self.pos, self.pos + n
        return np.unpackbits(self.array[i >> 3:(i + n + 7) >> 3])[i & 7:(i & 7) + n]

    def words(self, step: int, n: int) -> np.ndarray:
        """The 16 bits at each of n places that are ``step`` apart."""
        if step == 8:
            i, a = self.pos >> 3, self.array
            w = a[i:i + n].astype(np.uint32) << np.uint32(16) | a[i + 1:i + n + 1].astype(np.uint32) << np.uint32(8) | a[i + 2:i + n + 2]
            return w >> np.uint32(8 - (self.pos & 7)) & np.uint32(0xFFFF)
        at = self.pos + step * np.arange(n)
        i, a = at >> 3, self.array
        w = a[i].astype(np.uint32) << np.uint32(16) | a[i + 1].astype(np.uint32) << np.uint32(8) | a[i + 2]
        return w >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)


def _signed(x, size):
    """A magnitude of ``size`` bits as a signed number."""
    return x if x >> size - 1 else x - (1 << size) + 1


def _dc_first(bits: Bits, coef: list[np.ndarray], order: list[np.ndarray], tables: list[list[int]], al: int) -> None:
    """First pass over DC: differences to the block before, for the blocks of each component in each MCU."""
    last, made = [0] * len(coef), [[] for _ in coef]
    plan = [k for k, blocks in enumerate(order) for _ in range(blocks.shape[1])]
    for _ in range(len(order[0])):
        for k in plan:
            size = bits.symbol(tables[k])
            if size:
                last[k] += _signed(bits.take(size), size)
            made[k].append(last[k])
    for c, blocks, values in zip(coef, order, made):
        c[blocks.ravel(), 0] = np.array(values, np.int32) << al


def _dc_refine(bits: Bits, coef: list[np.ndarray], order: list[np.ndarray], al: int) -> None:
    """One more bit of every DC coefficient."""
    width = sum(b.shape[1] for b in order)
    more = bits.run(width * len(order[0])).reshape(-1, width).astype(np.int32) << al
    at = 0
    for c, blocks in zip(coef, order):
        c[blocks.ravel(), 0] |= more[:, at:at + blocks.shape[1]].ravel()
        at += blocks.shape[1]


def _ac_first(bits: Bits, flat: np.ndarray, band: int, table: tuple[np.ndarray, list[int]], al: int) -> None:
    """First pass over a band; ``flat`` has the band's coefficients of all blocks, one block after the other.

    Symbols of one kind (no zeros before, equal size) that follow each other are taken together.
    """
    lut, quick = table
    at, end = 0, len(flat)
    while at < end:
        x = quick[bits.peek16()]
        length, run, size = x >> 8, (x & 255) >> 4, x & 15
        step, most = length + size, 64
        same = n = 0
        while x and size and not run and step <= 16 and same == n and at < end:
            n = min(most, end - at, (bits.end - bits.pos) // step)
            if not n:
                raise ValueError("the scan ends too soon")
            w = bits.words(step, n)
            alike = lut[w] == x
            same = n if alike.all() else int(alike.argmin())
            v = (w[:same] >> np.uint32(16 - step)).astype(np.int32) & (1 << size) - 1
            flat[at:at + same] = np.where(v >> size - 1, v, v - (1 << size) + 1) << al
            at, bits.pos, most = at + same, bits.pos + step * same, most * 4
        if n:
            continue
        bits.symbol(quick)
        if size:
            at += run
            if at >= end:
                raise ValueError("a coefficient beyond the scan")
            flat[at] = _signed(bits.take(size), size) << al
            at += 1
        elif run == 15:
            at += 16
        else:
            at = (at // band + (1 << run) + bits.take(run)) * band


def _correct(bits: Bits, flat: np.ndarray, one: int) -> None:
    """A correction bit for each coefficient that isn't zero: it moves away from zero if the bit is set."""
    old = np.flatnonzero(flat)
    move = old[bits.run(len(old)).astype(bool)]
    move = move[(flat[move] & one) == 0]
    flat[move] += np.where(flat[move] > 0, one, -one).astype(flat.dtype)


def _ac_refine(bits: Bits, flat: np.ndarray, band: int, table: tuple[np.ndarray, list[int]], al: int) -> None:
    """One more bit of a band: corrections of known coefficients and new ones of magnitude one.

    A run of blocks without new coefficients is corrected in one step.
    """
    quick, one = table[1], 1 << al
    at, end = 0, len(flat)
    while at < end:
        x = bits.symbol(quick)
        run, size = x >> 4, x & 15
        if not size and run < 15:
            to = (at // band + (1 << run) + bits.take(run)) * band
            if to > end:
                raise ValueError("a run beyond the scan")
            _correct(bits, flat[at:to], one)
            at = to
            continue
        if size > 1:
            raise ValueError("a new coefficient has magnitude one")
        new = (one if bits.take(1) else -one) if size else 0
        stop = (at // band + 1) * band
        while at < stop:
            if flat[at]:
                if bits.take(1) and not flat[at] & one:
                    flat[at] += one if flat[at] > 0 else -one
            elif run:
                run -= 1
            else:
                flat[at] = new
                at += 1
                break
            at += 1


def decode(data: bytes) -> Picture:
    """Accumulate all scans of a progressive JPEG (Huffman codes, 8 bits, no restart intervals) into coefficient arrays.

    A stream of another kind, or a broken one, is a ValueError.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    pic, tables, at, by = Picture(), {}, 2, {}
    hmax = vmax = wide = high = 0
    while True:
        if at + 4 > len(data) and data[at:at + 2] != b"\xff\xd9" or data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xD9:
            return pic
        size = int.from_bytes(data[at + 2:at + 4], "big")
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xFE:
            pic.comment = body
        elif marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                pic.quant[body[0] & 15] = np.frombuffer(body[1:1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                body = body[1 + n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = lookup(body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif marker == 0xC2:
            pic.height, pic.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            pic.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            hmax, vmax = max(c.h for c in pic.parts), max(c.v for c in pic.parts)
            wide, high = -(-pic.width // (8 * hmax)), -(-pic.height // (8 * vmax))
            for c in pic.parts:
                c.wide, c.high = wide * c.h, high * c.v
                c.coef = np.zeros((c.wide * c.high, 64), np.int32)
            by = {c.ident: c for c in pic.parts}
        elif marker == 0xDA:
            n = body[0]
            chosen = [(by[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            found = NEXT_MARKER.search(data, at)
            if not found:
                raise ValueError("the scan has no end")
            bits, at = Bits(data[at:found.start()]), found.start()
            parts = [c for c, _ in chosen]
            if n > 1:
                order = [_mcu_order(c.h, c.v, wide, high) for c in parts]
            else:
                c = parts[0]
                own = np.arange(c.high * c.wide).reshape(c.high, c.wide)
                order = [own[:-(-pic.height * c.v // (8 * vmax)), :-(-pic.width * c.h // (8 * hmax))].reshape(-1, 1)]
            if ss == 0 and ah == 0:
                _dc_first(bits, [c.coef for c in parts], order, [tables[t >> 4][1] for _, t in chosen], al)
            elif ss == 0:
                _dc_refine(bits, [c.coef for c in parts], order, al)
            else:
                c, table, rows = parts[0], tables[16 | chosen[0][1] & 15], order[0].ravel()
                flat = c.coef[rows, ss:se + 1].ravel()
                (_ac_refine if ah else _ac_first)(bits, flat, se - ss + 1, table, al)
                c.coef[rows, ss:se + 1] = flat.reshape(len(rows), -1)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0), 0xDD):
            raise ValueError("only progressive Huffman streams without restarts are read")


def planes(pic: Picture) -> list[np.ndarray]:
    """Each component at full resolution: inverse transform in numpy, samples repeated where it has fewer."""
    hmax, vmax, out = max(c.h for c in pic.parts), max(c.v for c in pic.parts), []
    for c in pic.parts:
        x = (c.coef * pic.quant[c.quant]).astype(np.float32) @ basis()
        x = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8)
        x = x.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
        out.append(x.repeat(vmax // c.v, 0).repeat(hmax // c.h, 1)[:pic.height, :pic.width])
    return out


def to_rgb(pic: Picture) -> np.ndarray:
    """(height, width, 3) tensor of unsigned bytes."""
    y, *chroma = planes(pic)
    y = y.astype(np.float32)
    if len(chroma) < 2:
        return np.repeat(y.astype(np.uint8)[:, :, None], 3, 2)
    cb, cr = (x.astype(np.float32) - np.float32(128) for x in chroma)
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0] = y + np.float32(1.402) * cr
    out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    out[..., 2] = y + np.float32(1.772) * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def payload_of(pic: Picture) -> bytes:
    """The payload that ``encode`` stored."""
    n = int(pic.comment.removeprefix(b"n="))
    blocks = max(1, -(-n // 64))
    coef = np.concatenate([c.coef for c in pic.parts])[:blocks]
    return (coef - OFFSET).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean colour, and a 64-bit hash: which of 4 x 16 areas are brighter than the mean."""
    h, w, _ = rgb.shape
    areas = rgb.reshape(4, h // 4, 16, w // 16, 3).mean((1, 3), dtype=np.float64)
    light = areas.mean(2)
    bits = np.packbits((light > light.mean()).ravel()).tobytes().hex()
    return f"{w}x{h}:" + ",".join(f"{x:.2f}" for x in areas.mean((0, 1))) + ":" + bits


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every whole text as a progressive JPEG. Null is the empty text, whose payload is 64 zero bytes."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                media = [encode(padded(t or b""), len(t or b"")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("t"))
    return src.mapInArrow(run, "doc_id long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media, rgb_shape, rgb, feature) of media made by ``store_texts``, from the stored bytes alone.

    ``rgb`` holds the full-resolution tensor, height x width x 3 unsigned bytes of shape ``rgb_shape``; ``tensor``
    gives it as an array. ``feature`` is taken from it. One image at a time is decoded; a part of a batch ends when its
    tensors have PART_BYTES.
    """
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.string())
    names = ["doc_id", "n_bytes", "payload", "media", "rgb_shape", "rgb", "feature"]

    def part(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for doc_id, media in zip(b.column(0), b.column(1)):
                media = media.as_py()
                pic = decode(media)
                rgb = to_rgb(pic)
                rows.append((doc_id.as_py(), int(pic.comment.removeprefix(b"n=")), payload_of(pic), media, list(rgb.shape), rgb.tobytes(), feature_of(rgb)))
                held += rgb.nbytes
                if held >= PART_BYTES:
                    yield part(rows)
                    rows, held = [], 0
            if rows:
                yield part(rows)

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, media binary, rgb_shape array<int>, rgb binary, feature string")


def tensor(rgb: bytes, shape) -> np.ndarray:
    """The stored tensor as an array."""
    return np.frombuffer(rgb, np.uint8).reshape(tuple(shape))


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes, digests and feature of every text's media, all from the bytes as read back.

    Each text is encoded, decoded from the stored bytes alone and digested in one task, so that no media cross a
    shuffle. ``rgb_sha256`` is that of the full-resolution tensor, which ``read_media`` returns as a column. Null is the
    empty text. Equal texts give equal values; repeated rows stay; an empty table gives an empty table; other columns
    are ignored. A very long text is one picture and takes about thirty times its size in memory while it's coded.
    """

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                media = encode(padded(text or b""), len(text or b""))
                pic = decode(media)
                back, rgb = payload_of(pic), to_rgb(pic)
                rows.append((doc_id, int(pic.comment.removeprefix(b"n=")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
                             len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb), hashlib.sha256(rgb).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rgb_sha256"]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("t"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_sha256 string")
