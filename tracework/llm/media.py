"""Media columns: progressive JPEG, written and read in numpy, many files at a time.

Storing. A payload (the text's UTF-8 bytes, zeros up to a positive multiple of
64) becomes the quantized coefficients of a three-component 4:2:0 progressive
JPEG: 64 bytes are one block, byte k the k-th coefficient in zigzag order. The
format's unit is the coefficient, which entropy coding keeps exactly; samples
would be rounded. The coefficient of a byte is its place in a fixed order, in turns above and below zero,
so that frequent bytes have short codes and none is zero. Blocks fill the luma plane, then both chroma planes. Scans:
DC without its last bit, coefficients 1-5 without their last bit, 6-63, then
the two refinements. A comment holds the unpadded length. Restart intervals of
``RESTART`` blocks cut every scan into segments. A payload of over ``PART_BYTES`` is stored as
several files, one after another, so memory doesn't grow with the longest text (but for the text and its payload themselves).

Reading. Any baseline-free (SOF2) file with up to four components, spectral
selection, successive approximation, restarts and end-of-band runs is read.
All segments of the same scan of all files in a batch are lanes that numpy
steps through together, a symbol at a time, accumulating into the coefficient
arrays. The inverse transform is a matrix product with integer entries (exact
in float64, so equal files give equal samples in any batch); chroma is
upsampled to full resolution and converted to RGB with integer arithmetic.

Defined cases: null and empty texts store one block of zeros; equal texts give
equal bytes; a null doc_id or repeated rows are ordinary rows; an empty table
gives an empty result; extra columns are kept, those named like a new one aren't.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, hide, ranges, show, utf8

RESTART = 8
CHUNK_BYTES = 3 << 20
PART_BYTES = 1 << 17
#: The bytes that come first in the order of coefficients (fixed values); the others follow by value. 195 begins accented letters in UTF-8.
COMMON = b" entihaorsdlcugmbpfv.wykz" + bytes([195]) + b",q\njx"
MAX_SIDE = 4095  # MCUs of 16 samples a side
#: (components, first coefficient, last, bit above that was sent before (0: none), lowest bit sent)
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 0), ((1,), 6, 63, 0, 0), ((2,), 6, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 5, 1, 0), ((1,), 1, 5, 1, 0), ((2,), 1, 5, 1, 0),
)


def zigzag() -> np.ndarray:
    """Place (8 row + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _lengths(common: dict[int, int], others: list[int], rest: int) -> dict[int, int]:
    return common | {s: rest for s in others if s not in common}


def _byte_order() -> tuple[np.ndarray, np.ndarray]:
    """(coefficient of each byte: 1, -1, 2, -2 and so on along the order; byte of each coefficient from -128 on)."""
    order = [*COMMON, *(b for b in range(256) if b not in COMMON)]
    coefficient = np.zeros(256, np.int16)
    byte = np.zeros(257, np.uint8)
    for place, b in enumerate(order):
        coefficient[b] = (place // 2 + 1) * (1 - place % 2 * 2)
        byte[coefficient[b] + 128] = b
    return coefficient, byte


COEFFICIENT, BYTE = _byte_order()


def _tables() -> dict[tuple[int, int], dict[int, int]]:
    """(class, number) -> code length of each symbol that the encoder uses. Lengths follow from how text bytes spread over the magnitudes."""
    runs = [r * 16 + s for r in range(5) for s in range(1, 8)]
    return {
        (0, 0): _lengths({s: 3 for s in range(5)}, list(range(10)), 5),
        (1, 0): _lengths({0x01: 2, 0x02: 2, 0x03: 2, 0x04: 3, 0x05: 4}, [0x00, *range(1, 9)], 7),
        (1, 1): _lengths({0x01: 2, 0x02: 2, 0x00: 3, 0x03: 4, 0x11: 4, 0x12: 4, 0x04: 6, 0x13: 6}, runs, 9),
        (1, 2): _lengths({0x01: 1, 0x00: 2}, [r * 16 + 1 for r in range(5)], 5),
    }


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    if code >= 1 << last:
        raise ValueError("no room for the codes")
    return out


TABLES = {k: codes(v) for k, v in _tables().items()}


def ac_table(first: int, high: int, low: int) -> int:
    return 2 if high else 1 if low else 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def _dht() -> bytes:
    body = b""
    for (kind, number), table in TABLES.items():
        by = sorted(table.items(), key=lambda x: (x[1][1], x[0]))
        counts = np.bincount([n for _, (_, n) in by], minlength=17)[1:17]
        body += bytes([kind << 4 | number, *counts.tolist(), *(s for s, _ in by)])
    return _segment(0xC4, body)


def _head(mcux: int, mcuy: int, n_bytes: int) -> bytes:
    frame = struct.pack(">BHHB", 8, mcuy * 16, mcux * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload-bytes %d" % n_bytes) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, frame) + _dht() + _segment(0xDD, struct.pack(">H", RESTART))


def _sos(comps, first, last, high, low) -> bytes:
    table = ac_table(first, high, low) if first else 0
    return _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, table]) for c in comps) + bytes([first, last, high << 4 | low]))


def _arrays(table: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in table.items():
        code[s], length[s] = c, n
    return code, length


def _bits_of(x: np.ndarray) -> np.ndarray:
    """Number of bits of non-negative integers below 2**52."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(category, its bits) of signed values."""
    size = _bits_of(np.abs(v))
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _write(value: np.ndarray, n: np.ndarray, segment: np.ndarray, segments: int) -> tuple[bytes, np.ndarray]:
    """Bit strings (at most 32 bits each) in order of their segment -> (stuffed bytes, segment offsets); segments are padded with ones."""
    per = np.bincount(segment, weights=n, minlength=segments).astype(np.int64)
    size = (per + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    within = np.cumsum(n) - n - np.repeat(np.cumsum(per) - per, np.bincount(segment, minlength=segments))
    at = start[segment] * 8 + within
    pad = size * 8 - per
    at, n, value = np.concatenate([at, start[:-1] * 8 + per]), np.concatenate([n, pad]), np.concatenate([value, (1 << pad) - 1])
    word = at >> 5
    shifted = value.astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64) if len(n) else value.astype(np.uint64)
    shifted[n == 0] = 0
    total = int(start[-1] + 3) // 4 + 2
    words = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=total)
    words += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
    data = words.astype(np.uint64).astype(">u4").view(np.uint8)[: start[-1]]
    full = np.flatnonzero(data == 255)
    offsets = start + np.searchsorted(full, start, "left")
    out = np.zeros(len(data) + len(full), np.uint8)
    out[np.arange(len(data)) + np.searchsorted(full, np.arange(len(data)), "left")] = data
    return out.tobytes(), offsets


def _first_ac(v: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of a band, (blocks, width), already shifted -> (value, bits, block) of each symbol."""
    code, length = _arrays(table)
    blocks, width = v.shape
    block, k = np.nonzero(v)
    x = v[block, k].astype(np.int64)
    before = np.full(len(k), -1)
    same = np.zeros(len(k), bool)
    same[1:] = block[1:] == block[:-1]
    before[same] = k[:-1][same[1:]]
    run = k - before - 1
    size, bits = _magnitude(x)
    symbol = (run & 15) << 4 | size
    value, n = code[symbol] << size | bits, length[symbol] + size
    order = block * 256 + k * 4 + 2
    items = [(value, n, block, order)]
    if (run > 15).any():
        long = np.flatnonzero(run > 15)
        times = run[long] >> 4
        items.append((np.full(times.sum(), code[0xF0]), np.full(times.sum(), length[0xF0]), np.repeat(block[long], times), np.repeat(order[long] - 1, times)))
    last = np.full(blocks, -1)
    np.maximum.at(last, block, k)
    open_ = np.flatnonzero(last < width - 1)
    items.append((np.full(len(open_), code[0]), np.full(len(open_), length[0]), open_, open_ * 256 + 255))
    value, n, block, order = (np.concatenate(x) for x in zip(*items, strict=True))
    by = np.argsort(order, kind="stable")
    return value[by], n[by], block[by]


def _refined_ac(c: np.ndarray, low: int, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _first_ac for a refinement of a band narrower than 16 coefficients (so no run needs ZRL)."""
    code, length = _arrays(table)
    blocks, width = c.shape
    size = np.abs(c.astype(np.int64)) >> low
    new = size == 1
    old = size > 1
    group = np.cumsum(new, 1) - new  # symbols before each coefficient; its bit follows the next symbol
    first = np.zeros((blocks, width), np.int64)
    zero_before = np.cumsum(size == 0, 1)
    block, k = np.nonzero(new)
    since = np.zeros(len(k), np.int64)
    same = np.zeros(len(k), bool)
    same[1:] = block[1:] == block[:-1]
    z = zero_before[block, k]
    since[same] = z[:-1][same[1:]]
    symbol = (z - since) << 4 | 1
    value, n = code[symbol] << 1 | (c[block, k] > 0), length[symbol] + 1
    order = block * 4096 + group[block, k] * 64
    count = new.sum(1)
    tail = ~new[:, -1]
    eob = np.flatnonzero(tail)
    ob, ok = np.nonzero(old)
    first = ob * 4096 + group[ob, ok] * 64 + 1 + ok
    value = np.concatenate([value, np.full(len(eob), code[0]), size[ob, ok] & 1])
    n = np.concatenate([n, np.full(len(eob), length[0]), np.ones(len(ob), np.int64)])
    where = np.concatenate([block, eob, ob])
    by = np.argsort(np.concatenate([order, eob * 4096 + count[eob] * 64, first]), kind="stable")
    return value[by], n[by], where[by]


def geometry(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(MCUs a row, rows of MCUs) that hold so many blocks, six in each."""
    need = np.maximum(-(-blocks // 6), 1)
    wide = -(-need // MAX_SIDE)
    return wide, -(-need // wide)


def encode(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One JPEG a row of payloads (lengths: positive multiples of 64 after padding here)."""
    n_bytes = np.diff(at)
    blocks = np.maximum(-(-n_bytes // 64), 1)
    mcux, mcuy = geometry(blocks)
    mcus = mcux * mcuy
    base = np.concatenate([[0], np.cumsum(mcus * 6)])
    coefs = np.zeros(int(base[-1]) * 64, np.int16)
    coefs[np.repeat(base[:-1] * 64, blocks * 64) + ranges(blocks * 64)] = COEFFICIENT[0]
    coefs[np.repeat(base[:-1] * 64, n_bytes) + ranges(n_bytes)] = COEFFICIENT[data]
    coefs = coefs.reshape(-1, 64)
    files = len(n_bytes)
    comp_blocks = np.stack([4 * mcus, mcus, mcus])
    comp_base = np.stack([base[:-1], base[:-1] + 4 * mcus, base[:-1] + 5 * mcus])
    parts: list[list[bytes]] = [[_head(x, y, n)] for x, y, n in zip(mcux.tolist(), mcuy.tolist(), n_bytes.tolist(), strict=True)]
    restarts = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    for comps, first, last, high, low in SCRIPT:
        if first:
            many = comp_blocks[comps[0]]
            row = np.repeat(np.arange(files), many)
            nth = ranges(many)
            source = comp_base[comps[0]][row] + nth
            table = TABLES[1, ac_table(first, high, low)]
            band = coefs[source, first : last + 1]
            value, n, block = _refined_ac(band, low, table) if high else _first_ac(np.sign(band) * (np.abs(band) >> low), table)
            unit = nth // RESTART
        else:
            many = mcus * 6
            row = np.repeat(np.arange(files), many)
            nth = ranges(many)
            mcu, j = nth // 6, nth % 6
            wide = mcux[row]
            y, x = mcu // wide, mcu % wide
            luma = (2 * y + (j >> 1)) * 2 * wide + 2 * x + (j & 1)
            comp = np.maximum(j - 3, 0)
            source = comp_base[comp, row] + np.where(comp == 0, luma, mcu)
            unit = mcu // RESTART
            dc = coefs[source, 0].astype(np.int64)
            block = np.arange(len(source))
            if high:
                value, n = dc >> low & 1, np.ones(len(dc), np.int64)
            else:
                dc >>= low
                before = np.zeros_like(dc)
                for c in range(3):
                    own = np.flatnonzero(comp == c)
                    same = np.zeros(len(own), bool)
                    same[1:] = (row[own[1:]] == row[own[:-1]]) & (unit[own[1:]] == unit[own[:-1]])
                    before[own[1:][same[1:]]] = dc[own[:-1][same[1:]]]
                code, length = _arrays(TABLES[0, 0])
                size, bits = _magnitude(dc - before)
                value, n = code[size] << size | bits, length[size] + size
        per_file = -(-(many // (1 if first else 6)) // RESTART)
        seg_base = np.concatenate([[0], np.cumsum(per_file)])
        segment = (seg_base[:-1][row] + unit)[block]
        raw, offsets = _write(value, n, segment, int(seg_base[-1]))
        head = _sos(comps, first, last, high, low)
        bounds, cuts = seg_base.tolist(), offsets.tolist()
        for f, out in enumerate(parts):
            out.append(head)
            for i, s in enumerate(range(bounds[f], bounds[f + 1])):
                if i:
                    out.append(restarts[(i - 1) & 7])
                out.append(raw[cuts[s] : cuts[s + 1]])
    return [b"".join([*out, b"\xff\xd9"]) for out in parts]


class Frame:
    """What one file's markers say. planes: (width, height, stride, rows) in blocks, by component."""

    __slots__ = ("width", "height", "comps", "quant", "scans", "comment", "end", "hmax", "vmax", "mcux", "mcuy", "planes")


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse(file: bytes, begin: int = 0) -> Frame:
    """The file that begins there; ``end`` is the place after its last marker."""
    f = Frame()
    f.scans, f.quant, f.comment = [], {}, b""
    tables: dict[int, bytes] = {}
    restart = 0
    if file[begin : begin + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    i = begin + 2
    while True:
        while file[i + 1] == 0xFF:
            i += 1
        marker = file[i + 1]
        if marker == 0xD9:
            f.end = i + 2
            return f
        size = int.from_bytes(file[i + 2 : i + 4], "big")
        body = file[i + 4 : i + 2 + size]
        i += 2 + size
        if marker == 0xC2:
            f.height, f.width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            f.comps = {body[6 + 3 * c]: (body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)}
            f.hmax, f.vmax = max(c[0] for c in f.comps.values()), max(c[1] for c in f.comps.values())
            f.mcux, f.mcuy = -(-f.width // (8 * f.hmax)), -(-f.height // (8 * f.vmax))
            f.planes = [(-(-(-(-f.width * h // f.hmax)) // 8), -(-(-(-f.height * v // f.vmax)) // 8), f.mcux * h, f.mcuy * v) for h, v, _ in f.comps.values()]
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG file")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                f.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int64)
                body = body[n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDA:
            n = body[0]
            ids = list(f.comps)
            comps = tuple(ids.index(body[1 + 2 * c]) for c in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple((tables.get(body[2 + 2 * c] >> 4), tables.get(16 + (body[2 + 2 * c] & 15))) for c in range(n))
            stop = _NEXT.search(file, i).start()
            shape = tuple(list(f.comps.values())[c][:2] for c in comps)
            f.scans.append(((comps, first, last, bits >> 4, bits & 15, used, restart, shape), file[i:stop]))
            i = stop


@lru_cache(64)
def lookup(spec: bytes) -> np.ndarray:
    """16 bits ahead -> code length * 256 + symbol."""
    out = np.zeros(1 << 16, np.int64)
    code = at = 0
    for n in range(1, 17):
        for symbol in spec[16 + at : 16 + at + spec[n - 1]]:
            start = code << (16 - n)
            out[start : start + (1 << (16 - n))] = n << 8 | symbol
            code += 1
        at += spec[n - 1]
        code <<= 1
    return out


class Lanes:
    """Bit readers of many segments."""

    def __init__(self, segments: list[bytes]):
        data = np.frombuffer(b"".join(segments) + b"\0" * 16, np.uint8).astype(np.uint64)
        n = len(data) - 8
        self.ahead = data[:n] << np.uint64(24) | data[1 : n + 1] << np.uint64(16) | data[2 : n + 2] << np.uint64(8) | data[3 : n + 3]
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        self.start = (np.cumsum(size) - size) * 8
        self.most = (n - 1) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 25 bits or more, as the top of 32."""
        at = np.minimum(at, self.most)
        return self.ahead[at >> 3] << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFF)

    def bits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.peek(at) << n.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _first_band(lanes: Lanes, table: np.ndarray, place, many, first: int, last: int, low: int, out: np.ndarray) -> None:
    """place(lane, nth block) -> row of out."""
    lane = np.arange(len(many))
    at, block, k = lanes.start.copy(), np.zeros_like(many), np.full_like(many, first)
    row = place(lane, block) * 64
    left = many > 0
    while True:
        if not left.all():
            lane, at, block, k, row = lane[left], at[left], block[left], k[left], row[left]
            if not len(lane):
                return
        entry = table[(lanes.peek(at) >> np.uint64(16)).astype(np.int64)]
        at += entry >> 8
        symbol = entry & 255
        run, size = symbol >> 4, symbol & 15
        eob = (size == 0) & (run < 15)
        n = np.where(eob, run, size)
        bits = lanes.bits(at, n)
        at += n
        k += run
        hit = size > 0
        value = np.where(bits >> (n - 1).clip(0), bits, bits - (1 << n) + 1) << low
        if hit.all():
            out[row + k.clip(max=63)] = value
        else:
            out[(row + k.clip(max=63))[hit]] = value[hit]
        k += 1
        k[eob] = last + 1
        done = k > last
        if done.any():
            over = np.flatnonzero(done)
            block[over] += 1
            skip = np.where(eob[over], (1 << run[over]) + bits[over] - 1, 0)  # blocks after this one that the run ends too
            block[over] += skip
            k[over] = first
            inside = over[block[over] < many[lane[over]]]
            row[inside] = place(lane[inside], block[inside]) * 64
            left = np.ones(len(lane), bool)
            left[over] = block[over] < many[lane[over]]
        else:
            left = done == False  # noqa: E712


def _refine_band(lanes: Lanes, table: np.ndarray, place, many, first: int, last: int, low: int, out: np.ndarray) -> None:
    lane = np.arange(len(many))
    at, block, k = lanes.start.copy(), np.zeros_like(many), np.full_like(many, first)
    ends, zeros, new, mode = (np.zeros_like(many) for _ in range(4))  # blocks of the end-of-band run; zeros to pass; value to place; 0: a symbol is next, 1: passing, 2: end of band
    row = place(lane, block) * 64
    left = many > 0
    one = 1 << low
    while True:
        if not left.all():
            lane, at, block, k, ends, zeros, new, mode, row = (x[left] for x in (lane, at, block, k, ends, zeros, new, mode, row))
            if not len(lane):
                return
        mode[(mode == 0) & (ends > 0)] = 2
        ask = np.flatnonzero(mode == 0)
        if len(ask):
            entry = table[(lanes.peek(at[ask]) >> np.uint64(16)).astype(np.int64)]
            at[ask] += entry >> 8
            run, size = (entry & 255) >> 4, entry & 15
            eob = (size == 0) & (run < 15)
            n = np.where(eob, run, size.clip(max=1))
            bits = lanes.bits(at[ask], n)
            at[ask] += n
            ends[ask] = np.where(eob, (1 << run) + bits, 0)
            new[ask] = np.where(size > 0, np.where(bits > 0, one, -one), 0)
            zeros[ask] = run
            mode[ask] = np.where(eob, 2, 1)
        cell = row + k
        value = out[cell].astype(np.int64)
        old = value != 0
        bit = lanes.bits(at, np.ones_like(at))
        at += old
        grow = old & (bit > 0) & (np.abs(value) & one == 0)
        if grow.any():
            out[cell[grow]] = value[grow] + np.where(value[grow] > 0, one, -one)
        zero = ~old & (mode == 1)
        there = zero & (zeros == 0)
        put = there & (new != 0)
        if put.any():
            out[cell[put]] = new[put]
        zeros -= zero & ~there
        mode[there] = 0
        k += 1
        done = k > last
        left = np.ones(len(lane), bool)
        if done.any():
            over = np.flatnonzero(done)
            ends[over] -= mode[over] == 2
            block[over] += 1
            k[over] = first
            mode[over] = 0
            left[over] = block[over] < many[lane[over]]
            inside = over[left[over]]
            row[inside] = place(lane[inside], block[inside]) * 64


def decode(files: list[bytes | Frame]) -> tuple[list[Frame], list[list[tuple[int, int]]], np.ndarray]:
    """(frames, by file and component (first row, blocks) of the coefficients, coefficients (rows, 64) in zigzag order). Files may be parsed already."""
    frames = [f if isinstance(f, Frame) else parse(f) for f in files]
    where, total = [], 0
    for f in frames:
        own = []
        for _, _, stride, rows in f.planes:
            own.append((total, stride * rows))
            total += stride * rows
        where.append(own)
    flat = np.zeros(total * 64, np.int16)
    for nth in range(max((len(f.scans) for f in frames), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(frames):
            if nth < len(f.scans):
                groups.setdefault(f.scans[nth][0], []).append(i)
        for key, own in groups.items():
            _scan(key, [frames[i] for i in own], [where[i] for i in own], [frames[i].scans[nth][1] for i in own], flat)
    return frames, where, flat.reshape(-1, 64)


def _scan(key, frames, where, data, flat) -> None:
    comps, first, last, high, low, used, restart, shape = key
    segments, file = [], []
    for i, raw in enumerate(data):
        parts = _RST.split(raw)
        segments += [p.replace(b"\xff\x00", b"\xff") for p in parts]
        file += [i] * len(parts)
    lanes = Lanes(segments)
    file = np.array(file)
    number = np.arange(len(file)) - np.searchsorted(file, file)
    if len(comps) == 1:
        c = comps[0]
        plane = np.array([f.planes[c] for f in frames])
        base = np.array([w[c][0] for w in where])
        units = plane[:, 0] * plane[:, 1]
    else:
        plane = base = None
        units = np.array([f.mcux * f.mcuy for f in frames])
    step = restart or int(units.max())
    first_unit = number * step
    many = np.minimum(units[file] - first_unit, step).clip(0)

    def place(lane, block):
        unit = first_unit[lane] + block
        own = file[lane]
        wide, stride = plane[own, 0], plane[own, 2]
        return base[own] + unit // wide * stride + unit % wide

    if first:
        (_refine_band if high else _first_band)(lanes, lookup(used[0][1]), place, many, first, last, low, flat)
        return
    # DC: the blocks of an MCU one after another
    if len(comps) == 1:
        pattern = [(0, None, None)]
    else:
        pattern = [(c, dy, dx) for c, (h, v) in enumerate(shape) for dy in range(v) for dx in range(h)]
        mcux = np.array([f.mcux for f in frames])
        planes = np.array([[f.planes[c] for c in comps] for f in frames])
        bases = np.array([[w[c][0] for c in comps] for w in where])

    def row_of(lane, unit, part):
        if len(comps) == 1:
            return place(lane, unit)
        c, dy, dx = part
        h, v = shape[c]
        own, mcu = file[lane], first_unit[lane] + unit
        return bases[own, c] + (mcu // mcux[own] * v + dy) * planes[own, c, 2] + mcu % mcux[own] * h + dx

    at = lanes.start.copy()
    before = np.zeros((len(file), len(comps)), np.int64)
    for unit in range(int(many.max(initial=0))):
        lane = np.flatnonzero(many > unit)
        for part in pattern:
            row = row_of(lane, np.full(len(lane), unit), part) * 64
            if high:
                flat[row] |= (lanes.bits(at[lane], np.ones(len(lane), np.int64)) << low).astype(np.int16)
                at[lane] += 1
                continue
            table = lookup(used[part[0]][0])
            entry = table[(lanes.peek(at[lane]) >> np.uint64(16)).astype(np.int64)]
            at[lane] += entry >> 8
            size = entry & 255
            bits = lanes.bits(at[lane], size)
            at[lane] += size
            diff = np.where(size == 0, 0, np.where(bits >> (size - 1).clip(0), bits, bits - (1 << size) + 1))
            before[lane, part[0]] += diff
            flat[row] = before[lane, part[0]] << low


@lru_cache(1)
def _basis() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples), in units of 2**-13."""
    i = np.arange(8)
    one = np.cos((2 * i[None, :] + 1) * i[:, None] * np.pi / 16) * np.where(i == 0, np.sqrt(1 / 8), 0.5)[:, None]
    both = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)
    return np.rint(both[zigzag()] * 8192)


def samples(coefs: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """(blocks, 64) uint8 of (blocks, 64) coefficients."""
    x = coefs.astype(np.float64)
    if quant is not None and (quant != 1).any():
        x *= quant
    return np.clip(np.floor((x @ _basis() + 4096) / 8192) + 128, 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """uint8 planes of one shape -> (..., 3) uint8, in 16-bit fixed point."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
    return out


def tensor(frame: Frame, where: list[tuple[int, int]], coefs: np.ndarray, pixels: np.ndarray | None = None) -> np.ndarray:
    """(height, width, 3) uint8 at full resolution; one-component files are grey. pixels: the samples of all coefs, where they are known."""
    planes = []
    for (start, n), (_, _, stride, rows), (h, v, q) in zip(where, frame.planes, frame.comps.values(), strict=True):
        plane = (samples(coefs[start : start + n], frame.quant[q]) if pixels is None else pixels[start : start + n]).reshape(rows, stride, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, stride * 8)
        plane = plane.repeat(frame.vmax // v, 0).repeat(frame.hmax // h, 1)
        planes.append(plane[: frame.height, : frame.width])
    return to_rgb(*planes[:3]) if len(planes) >= 3 else np.repeat(planes[0][..., None], 3, 2)


def encode_column(docs: DataFrame) -> DataFrame:
    """docs with text -> columns of docs but text, n_bytes, media (binary: a file, or several in a row for a long payload)."""
    rows, others = hide(docs, ["text"], ["n_bytes", "media"])
    columns = [c for c in rows.columns if c != "text"]

    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            n_parts = np.maximum(-(-np.diff(at) // PART_BYTES), 1)
            row = np.repeat(np.arange(piece.num_rows), n_parts)
            start = at[row] + ranges(n_parts) * PART_BYTES
            stop = np.minimum(start + PART_BYTES, at[row + 1])
            media: list[list[bytes]] = [[] for _ in range(piece.num_rows)]
            first = 0
            while first < len(row):
                last = max(first + 1, int(np.searchsorted(stop, start[first] + CHUNK_BYTES, "right")))
                files = encode(data[start[first] : stop[last - 1]], np.append(start[first:last], stop[last - 1]) - start[first])
                for i, file in zip(row[first:last].tolist(), files, strict=True):
                    media[i].append(file)
                first = last
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], pa.array(np.diff(at)), pa.array([b"".join(m) for m in media], pa.binary())], [*columns, "n_bytes", "media"])

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return show(rows.mapInArrow(run, schema), [], others, ["n_bytes", "media"])


def _parts(media: bytes):
    """The frames of the files that stand one after another."""
    at = 0
    while at < len(media):
        frame = parse(media, at)
        at = frame.end
        yield frame


class _Row:
    """What is put together of one row's files."""

    def __init__(self):
        self.payload, self.rgb, self.height, self.width, self.sums = [], [], 0, 0, np.zeros(3, np.int64)


def _decoded(media: list[bytes], keep_rgb: bool) -> list[_Row]:
    rows = [_Row() for _ in media]
    held: list[tuple[int, Frame]] = []
    blocks = 0

    def solve():
        frames, where, coefs = decode([f for _, f in held])
        # Without quantization one product serves all files.
        plain = all((q == 1).all() for f in frames for q in f.quant.values())
        pixels = samples(coefs) if plain else None
        for (i, _), f, own in zip(held, frames, where, strict=True):
            row, n = rows[i], int(f.comment.rpartition(b" ")[2])
            start = own[0][0]
            row.payload.append(BYTE[coefs[start : start + max(-(-n // 64), 1)] + 128].tobytes())
            image = tensor(f, own, coefs, pixels)
            row.height, row.width = row.height + image.shape[0], image.shape[1]
            row.sums += image.sum((0, 1), dtype=np.int64)
            if keep_rgb:
                row.rgb.append(image.tobytes())

    for i, file in enumerate(media):
        for frame in _parts(file):
            held.append((i, frame))
            blocks += sum(stride * high for _, _, stride, high in frame.planes)
            if blocks * 64 >= CHUNK_BYTES:
                solve()
                held, blocks = [], 0
    if held:
        solve()
    return rows


def decode_column(stored: DataFrame, digest: bool = False) -> DataFrame:
    """stored with media -> its other columns, then payload, height, width, rgb (full-resolution tensor's bytes; those of several files one below another); with digest, what op10 returns instead of them."""
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"} if digest else {"payload": "binary", "height": "int", "width": "int", "rgb": "binary"}
    names = list(kinds)
    hidden, others = hide(stored, ["media"], names)
    columns = [c for c in hidden.columns if c != "media"]

    def run(batches):
        for piece in chunks(batches, "media", CHUNK_BYTES):
            files = piece.column("media").to_pylist()
            rows = _decoded(files, not digest)
            payloads = [b"".join(r.payload) for r in rows]
            if digest:
                feature = [f"{r.height}x{r.width}:{':'.join(map(str, r.sums))}" for r in rows]
                sha = [hashlib.sha256(p).hexdigest() for p in payloads]
                new = [pa.array(list(map(len, payloads)), pa.int64()), pa.array(sha), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()), pa.array(list(map(len, files)), pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(feature)]
            else:
                new = [pa.array(payloads, pa.binary()), pa.array([r.height for r in rows], pa.int32()), pa.array([r.width for r in rows], pa.int32()), pa.array([b"".join(r.rgb) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], *new], [*columns, *names])

    schema = T.StructType([*[hidden.schema[c] for c in columns], *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])
    return show(hidden.mapInArrow(run, schema), [], others, names)
