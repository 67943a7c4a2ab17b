"""Suffix-array dedup of repeated byte strings, sorted deep-shallow.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start); strings are judged
on the input. The work follows the repeats, not all suffixes:

1. Anchors. Every string of ``length`` bytes names one anchor, the leftmost
   smallest hash of its k-grams, so equal strings have equal anchors at equal
   offsets. Consecutive strings share an anchor; a row an anchor (about one in
   40 bytes) holds their range. Spark counts the anchors' k-grams and keeps the
   anchors whose k-gram occurs twice or more; all other strings are unique.
2. Suffixes. Each kept anchor's surroundings (at most ``2 length - k`` bytes)
   go to the task of its k-gram. Equal surroundings are first reduced to the
   earliest in every batch, before the shuffle. A k-gram with more than one ``HOT``th of
   all repeated anchors (so there are fewer than ``HOT`` of them: this list alone is broadcast) is hot: its anchors are
   reduced over the whole task and dealt by ``CLASSES`` longer k-grams, each of which lies in
   all strings of a range of offsets.
3. Deep-shallow sorting orders the suffixes that start at the anchors, and
   the reversed prefixes that end there: multikey quicksort (three parts
   around a pivot, 8 bytes at a time, all groups of a block in step) down to ``SHALLOW``
   bytes, then blind tries for groups that still tie.
   Neighbours' common prefixes in both orders tell, for every offset, which
   strings are equal; the earliest of each is *fresh*.
4. Strings of kept anchors that aren't fresh are repeats; the bytes they cover go.

Defined cases: null texts are empty; texts shorter than ``length`` stay whole;
a null doc_id counts as smaller than all others; rows that share a doc_id and
a text are one document and give equal results; rows that share a doc_id (or have none) but
not the text are documents of their own, ordered by a hash of the text; an empty table
gives an empty result; other columns are kept, those named like a new one aren't. Texts are cut
into windows where that bounds memory; the last step needs about 30 bytes a byte of a text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, chunks, hide, ranges, show, utf8, written

LENGTH = 100
GRAM = 24
SHALLOW = 32
CHUNK_BYTES = 1 << 20
BLOCK_ROWS = 40_000
HOT = 1024
CLASSES = 4
ANCHORS_AT_ONCE = 1 << 13
#: packed: start of the anchor's first string (31 bits), checksum of the text (16), strings - 1 (7), anchor's place after the start (7); above them whether its k-gram is hot
_START, _SUM, _MANY = 30, 14, 7
_HOT_BIT = 1 << 61
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    """A 64-bit code of each byte value, by a mixing rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_CODE = _byte_codes()


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place, by doubling (8, 16, 24 bytes)."""
    h = _CODE[data]
    for n in (1, 2, 4):
        h = h[: len(h) - n] * _power(n) + h[n:]
    eight = h
    sixteen = eight[:-8] * _power(8) + eight[8:]
    h = sixteen[: len(sixteen) - 8] * _power(8) + eight[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """(row, start in the row, strings, place of the anchor after the start, k-gram hash) for all strings of the rows."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return empty
    lengths = np.diff(at)
    many = np.maximum(lengths - length + 1, 0)
    if not many.any():
        return empty
    hashes = gram_hashes(data)
    low31 = np.uint64((1 << 31) - 1)
    best = (hashes & ~low31) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    row = np.repeat(np.arange(len(lengths)), many)
    start = ranges(many)
    where = start + at[row]
    anchor = (best[where] & low31).astype(np.int64)
    first = np.ones(len(where), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    strings = np.diff(np.append(head, len(where)))
    return row[head], start[head], strings, anchor[head] - where[head], hashes[anchor[head]]


def anchors_in_windows(data: np.ndarray, at: np.ndarray, length: int = LENGTH, window: int = CHUNK_BYTES):
    """As anchors, but a single long row is cut into windows of its strings (an anchor at a border then has two ranges)."""
    if len(at) != 2 or len(data) <= window:
        return anchors(data, at, length)
    found = []
    for first in range(0, len(data) - length + 1, window):
        part = data[first : first + window + length - 1]
        row, start, strings, place, gram = anchors(part, np.array([0, len(part)]), length)
        found.append((row, start + first, strings, place, gram))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(start, check, strings, place):
    return (start << _START) | (check << _SUM) | ((strings - 1) << _MANY) | place


def _unpack(packed: np.ndarray):
    """(start, checksum, strings, place)."""
    return packed >> _START, packed >> _SUM & 0xFFFF, (packed >> _MANY & 127) + 1, packed & 127


def _checks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    view, at = memoryview(np.ascontiguousarray(data)), at.tolist()
    return np.fromiter((zlib.crc32(view[a:b]) & 0xFFFF for a, b in zip(at, at[1:])), np.int64, len(at) - 1)


def _anchor_rows(length: int, with_place: bool):
    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            row, start, strings, place, gram = anchors_in_windows(data, at, length)
            columns, names = [pa.array(gram.view(np.int64))], ["gram"]
            if with_place:
                packed = _pack(start, _checks(data, at)[row], strings, place)
                columns += [piece.column("key").take(pa.array(row)), pa.array(packed)]
                names += ["key", "packed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _words(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from ``depth`` on of each string as big-endian numbers; zero past its end. The buffer has 8 spare bytes."""
    out = np.zeros(len(start), np.uint64)
    for i in range(8):
        there = depth + i < length
        byte = np.where(there, buffer[np.where(there, start + depth + i, 0)], 0)
        out = out << np.uint64(8) | byte.astype(np.uint64)
    return out


class BlindTrie:
    """Orders byte strings by branching places only; each string is compared in full with one other.

    A node is [depth, children by byte] (-1: the string ends there), a leaf the
    list of the numbers of equal strings.
    """

    def __init__(self):
        self.root = None
        self.text: list[bytes] = []

    @staticmethod
    def _symbol(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def add(self, text: bytes) -> None:
        number = len(self.text)
        self.text.append(text)
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: skips what lies between branching places
            node = node[1].get(self._symbol(text, node[0])) or next(iter(node[1].values()))
        other = self.text[node[0]]
        if other == text:
            node.append(number)
            return
        depth = self.common(text, other)
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][self._symbol(text, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._symbol(text, depth)] = [number]
            return
        branch = (depth, {self._symbol(other, depth): node, self._symbol(text, depth): [number]})
        if above is None:
            self.root = branch
        else:
            above[1][self._symbol(text, above[0])] = branch

    def ordered(self) -> list[tuple[int, int]]:
        """[(number, common prefix with the one before)] in order."""
        out, stack = [], [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if isinstance(node, tuple):
                below = sorted(node[1].items())
                for j in range(len(below) - 1, -1, -1):
                    stack.append((below[j][1], node[0] if j else common))
            else:
                for i, number in enumerate(node):
                    out.append((number, len(self.text[number]) if i else common))
        return out


def multikey_quicksort(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, border) of strings within their sorted groups, by their first ``shallow`` bytes.

    border: -1 at a group's first place; the depth at which a place's string parted from the one
    before; ``shallow`` where the two still tie. Every segment that is not yet in order is parted at once
    around the median of three of its strings' next 8 bytes (and what is left of the string): less, equal, greater; equals go 8 bytes deeper.
    """
    n = len(start)
    order = np.arange(n)
    border = np.full(n, shallow, np.int64)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    border[new] = -1
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    depth = np.zeros(len(head), np.int64)
    while True:
        live = (size > 1) & (depth < shallow)
        head, size, depth = head[live], size[live], depth[live]
        if not len(head):
            return order, border
        segment = np.repeat(np.arange(len(head)), size)
        nth = ranges(size)
        own = order[head[segment] + nth]
        word = _words(buffer, start[own], length[own], depth[segment])
        left = (length[own] - depth[segment]).clip(0, 8)
        base = np.cumsum(size) - size
        three = np.stack([base, base + size // 2, base + size - 1])
        by = np.lexsort((left[three], word[three]), axis=0)[1]
        pivot = three[by, np.arange(len(head))]
        p_word, p_left = word[pivot][segment], left[pivot][segment]
        less = (word < p_word) | ((word == p_word) & (left < p_left))
        equal = (word == p_word) & (left == p_left)
        count = lambda flags: np.bincount(segment[flags], minlength=len(head))
        n_less, n_equal = count(less), count(equal)
        place = np.empty(len(own), np.int64)
        for flags, shift in ((less, 0 * n_less), (equal, n_less), (~(less | equal), n_less + n_equal)):
            rank = np.cumsum(flags) - 1
            rank -= np.append(0, np.cumsum(flags))[base][segment]
            place[flags] = (head[segment] + shift[segment] + rank)[flags]
        order[place] = own
        middle, end = head + n_less, head + n_less + n_equal
        border[middle[n_less > 0]] = depth[n_less > 0]
        border[end[end < head + size]] = depth[end < head + size]
        # strings that end here are equal: no more to order
        deeper = np.where(left[pivot] == 8, depth + 8, shallow)
        head, size, depth = np.concatenate([head, middle, end]), np.concatenate([n_less, n_equal, size - n_less - n_equal]), np.concatenate([depth, deeper, depth])


def deep_shallow(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of strings within their groups; -1 at a group's first.

    group: sorted group numbers. The order is by group, then by string.
    """
    order, border = multikey_quicksort(buffer, start, length, group, shallow)
    common = border.copy()
    place = np.flatnonzero((border >= 0) & (border < shallow))
    if len(place):
        depth, one, two = common[place], order[place - 1], order[place]
        x = _words(buffer, start[one], length[one], depth) ^ _words(buffer, start[two], length[two], depth)
        same = np.zeros(len(x), np.int64)
        for i in range(8):
            same += x < np.uint64(1) << np.uint64(8 * (7 - i)) if i < 7 else x == 0
        common[place] = depth + same
    tied = border == shallow
    tied[:-1] |= tied[1:]
    place = np.flatnonzero(tied)
    if len(place):
        first = border[place] != shallow
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(place))
        raw = buffer.tobytes()
        starts, stops = start.tolist(), (start + length).tolist()
        for a, b in zip(heads.tolist(), ends.tolist()):
            own = order[place[a] : place[a] + b - a].tolist()
            trie = BlindTrie()
            for i in own:
                trie.add(raw[min(starts[i] + shallow, stops[i]) : stops[i]])
            at = place[a]
            for j, (number, prefix) in enumerate(trie.ordered()):
                order[at + j] = own[number]
                if j:
                    common[at + j] = shallow + prefix
    inside = np.flatnonzero(common >= 0)
    common[inside] = np.minimum(common[inside], np.minimum(length[order[inside]], length[order[inside - 1]]))
    return order, common


def fresh_strings(gram: np.ndarray, packed: np.ndarray, data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in order of age, whole k-gram groups together: (low, high) bit masks of the strings that occur first here.

    Bit j of low is string j, bit j of high string 39 + j.
    """
    n = len(gram)
    _, _, strings, place = _unpack(packed)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, number, count = np.unique(gram, return_inverse=True, return_counts=True)
    alone = count[number] == 1
    fresh = np.zeros((n, length - GRAM + 1), bool)
    fresh[alone] = np.arange(fresh.shape[1]) < strings[alone, None]
    more = np.flatnonzero(~alone)
    if len(more):
        more = more[np.argsort(number[more], kind="stable")]  # by group, by age within it
        group, place, strings = number[more], place[more], strings[more]
        start, stop = at[more], at[more + 1]
        buffer = np.concatenate([data, np.zeros(8, np.uint8)])
        order, right = deep_shallow(buffer, start + place, stop - start - place, group)
        # the same for what stands before the anchor, read backwards
        back = np.concatenate([data[::-1], np.zeros(8, np.uint8)])
        order_left, left = deep_shallow(back, len(data) - start - place, place, group)
        for offset in range(length - GRAM + 1):
            here = np.flatnonzero((place >= offset) & (place - offset < strings))
            if not len(here):
                continue
            after, before = np.empty(len(more), np.int64), np.empty(len(more), np.int64)
            after[order] = np.cumsum(right < length - offset)
            before[order_left] = np.cumsum(left < offset)
            _, first = np.unique(after[here] * (len(more) + 1) + before[here], return_index=True)
            first = here[first]
            fresh[more[first], place[first] - offset] = True
    half = 39
    for j in range(fresh.shape[1]):
        (low if j < half else high)[:] |= fresh[:, j].astype(np.int64) << (j % half)
    return low, high


def _hash_from(data: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place, as gram_hashes makes it."""
    h = _CODE[data[first]]
    for i in range(1, n):
        h = h * _BASE + _CODE[data[first + i]]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def by_class(start: np.ndarray, strings: np.ndarray, place: np.ndarray, length: int):
    """Anchors -> (number of the anchor, start, strings, place, bytes of the class's k-gram before the anchor, after it), one for each class that has strings.

    A class is a range of places that the anchor takes in a string; all its strings hold the same bytes around the anchor.
    """
    edges = [round(i * (length - GRAM + 1) / CLASSES) for i in range(CLASSES + 1)]
    out = []
    for low, high in zip(edges, edges[1:]):
        # string j has the anchor at place - j
        first, last = np.maximum(place - high + 1, 0), np.minimum(place - low, strings - 1)
        own = np.flatnonzero(first <= last)
        n = len(own)
        out.append((own, start[own] + first[own], last[own] - first[own] + 1, place[own] - first[own], np.full(n, low), np.full(n, length - GRAM - high + 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _surroundings(length: int):
    """Rows with the texts and their kept anchors -> gram, doc_id, key, packed, u (bytes of all the anchor's strings); the earliest of equal ones in a batch, of hot ones in the task."""

    def run(batches):
        seen: dict[tuple[int, int], tuple[int, int, int]] = {}
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            kept = piece.column("kept").combine_chunks() if isinstance(piece.column("kept"), pa.ChunkedArray) else piece.column("kept")
            every_row = np.repeat(np.arange(piece.num_rows), np.diff(kept.offsets.to_numpy()))
            every_packed = kept.flatten().to_numpy()
            own = _unpack(every_packed)[1] == _checks(data, at)[every_row]
            every_row, every_packed = every_row[own], every_packed[own]
            keys, ids = piece.column("key").to_numpy(), piece.column("age").to_numpy()
            for first in range(0, len(every_row), ANCHORS_AT_ONCE):
                row, packed = every_row[first : first + ANCHORS_AT_ONCE], every_packed[first : first + ANCHORS_AT_ONCE]
                hot = packed & _HOT_BIT > 0
                start, check, strings, place = _unpack(packed & ~_HOT_BIT)
                number, h_start, h_strings, h_place, before, after = by_class(start[hot], strings[hot], place[hot], length)
                row, check = np.concatenate([row[~hot], row[hot][number]]), np.concatenate([check[~hot], check[hot][number]])
                cold = int((~hot).sum())
                start, strings, place = np.concatenate([start[~hot], h_start]), np.concatenate([strings[~hot], h_strings]), np.concatenate([place[~hot], h_place])
                packed = _pack(start, check, strings, place)
                begin = at[row] + start
                size = strings + length - 1
                data_of = data[np.repeat(begin, size) + ranges(size)]
                nth = ranges(size).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                mixed = _CODE[data_of] * nth
                mixed ^= mixed >> np.uint64(29)
                ends = np.cumsum(size)
                # 128 bits of the bytes and the anchor's place
                whole = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), ends - size) + place.astype(np.uint64)
                mixed *= nth
                mixed ^= mixed >> np.uint64(31)
                other = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), ends - size) ^ whole
                key, age = keys[row], ids[row]
                by = np.lexsort((packed, key, age, other, whole))
                new = np.ones(len(by), bool)
                new[1:] = (whole[by[1:]] != whole[by[:-1]]) | (other[by[1:]] != other[by[:-1]])
                pick = np.sort(by[new])
                if cold < len(row):
                    keep = np.ones(len(pick), bool)
                    for i in np.flatnonzero(pick >= cold).tolist():
                        name = (int(whole[pick[i]]), int(other[pick[i]]))
                        mine = (int(age[pick[i]]), int(key[pick[i]]), int(packed[pick[i]]))
                        keep[i] = name not in seen or mine < seen[name]
                        if keep[i]:
                            seen[name] = mine
                    if len(seen) > 200_000:  # it only saves rows; what it forgets is reduced later
                        seen.clear()
                    pick = pick[keep]
                gram = _hash_from(data, begin + place, GRAM)
                if cold < len(row):
                    gram[cold:] = _class_grams(data, (begin + place)[cold:], before, after, length)
                size = size[pick]
                u = data[np.repeat(begin[pick], size) + ranges(size)]
                offsets = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[pick].view(np.int64)), pa.array(age[pick]), pa.array(key[pick]), pa.array(packed[pick]), binary_array(u, offsets).cast(pa.binary())], ["gram", "age", "key", "packed", "u"]
                )

    return run


def _class_grams(data: np.ndarray, anchor: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(anchor), np.uint64)
    for low in np.unique(before).tolist():
        own = before == low
        tail = int(after[own][0])
        out[own] = _hash_from(data, anchor[own] - low, low + GRAM + tail) + np.uint64((low + 1) * int(_BASE) % (1 << 64))
    return out


def _sorted_blocks(length: int):
    """Rows sorted by gram -> key, packed, low, high of the earliest anchors; whole k-gram groups at a time."""

    def solve(table: pa.Table):
        table = table.combine_chunks()
        age, key, packed, gram = (table.column(c).to_numpy() for c in ("age", "key", "packed", "gram"))
        by = np.lexsort((packed, key, age))
        u = table.column("u").take(pa.array(by))
        data, at = utf8(u.combine_chunks() if isinstance(u, pa.ChunkedArray) else u)
        low, high = fresh_strings(gram[by], packed[by], data, at, length)
        some = np.flatnonzero(low | high)
        return pa.RecordBatch.from_arrays([pa.array(key[by][some]), pa.array(packed[by][some]), pa.array(low[some]), pa.array(high[some])], ["key", "packed", "low", "high"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                gram = batch.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1], "left"))  # the last group may go on
                if cut:
                    yield solve(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                    held, rows = [batch.slice(cut)], batch.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _cut(others: list[str], length: int, keep: bool):
    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            n = piece.num_rows
            checks = _checks(data, at)
            repeat = np.zeros(len(data) + 1, bool)

            def strings_of(name):
                column = piece.column(name).fill_null([]) if piece.column(name).null_count else piece.column(name)
                row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
                return row, column.flatten()

            row, packed = strings_of("kept")
            start, check, strings, _ = _unpack(packed.to_numpy() & ~_HOT_BIT)
            own = check == checks[row]
            repeat[np.repeat((at[row] + start)[own], strings[own]) + ranges(strings[own])] = True
            row, fresh = strings_of("fresh")
            start, check, _, _ = _unpack(fresh.field("packed").to_numpy())
            own = check == checks[row]
            begin = (at[row] + start)[own]
            for name, shift in (("low", 0), ("high", 39)):
                bits = fresh.field(name).to_numpy()[own]
                for j in range(39):
                    set_ = (bits >> j & 1).astype(bool)
                    repeat[begin[set_] + shift + j] = False
            step = np.zeros(len(data) + length + 1, np.int32)
            hit = np.flatnonzero(repeat)
            step[hit] += 1
            step[hit + length] -= 1
            gone = np.cumsum(step, dtype=np.int32)[: len(data)] > 0
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(gone, out=total[1:])
            removed = total[at[1:]] - total[at[:-1]]
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            border = at[:-1][at[:-1] < len(data)]
            head[border] = gone[border]
            spans = np.concatenate([[0], np.cumsum(head)])
            left = data[~gone]
            kept_at = at - total[at]
            view, cuts = memoryview(left), kept_at.tolist()
            digest = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            columns = [*[piece.column(c) for c in others], pa.array(np.diff(at)), pa.array(removed), pa.array(spans[at[1:]] - spans[at[:-1]]), pa.array(digest)]
            names = [*others, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                text = [str(view[a:b], "utf-8", "ignore") for a, b in zip(cuts, cuts[1:])]
                columns += [binary_array(left, kept_at).cast(pa.binary()), pa.array(text, pa.string())]
                names += ["kept_bytes", "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, keep: bool = False) -> DataFrame:
    """doc_id, the other columns of docs but text, then n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes, kept_text: without characters that a cut splits).

    ``length`` is at least GRAM + 1 and at most GRAM + 77.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes", "kept_text"] * keep]
    hidden, others = hide(docs, ["doc_id", "text"], new)
    # A row's key is 64 bits of its doc_id and text; with the 16 bits in packed, 80 bits tell rows apart.
    key = F.xxhash64("doc_id", "text").alias("key")
    text = hidden.select(key, "text")
    counts = text.select("text").mapInArrow(_anchor_rows(length, False), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts, "suffix-grams")
    all_ = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(all_ // HOT, 1)).select("gram", F.lit(True).alias("hot"))
    anchored = text.mapInArrow(_anchor_rows(length, True), "gram long, key long, packed long").join(F.broadcast(hot), "gram", "left")
    # Hot anchors are known to stay, so they are dealt by themselves.
    anchored = anchored.withColumn("deal", F.when(F.col("hot"), F.xxhash64("key", "packed")).otherwise(F.col("gram")))
    cold = counts.where(F.col("n") <= max(all_ // HOT, 1)).select(F.col("gram").alias("t_gram"))
    kept = anchored.join(cold, F.col("deal") == F.col("t_gram"), "left").where("hot or t_gram is not null")
    kept = kept.withColumn("packed", F.when(F.col("hot"), F.col("packed").bitwiseOR(F.lit(_HOT_BIT))).otherwise(F.col("packed")))
    kept = written(kept.groupBy("key").agg(F.collect_set("packed").alias("kept")), "suffix-anchors")
    # One exchange of the texts serves both joins below.
    dealt = hidden.withColumn("key", key).repartition("key")
    found = dealt.join(kept.hint("shuffle_hash"), "key", "left")
    age = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("age")
    fresh = (
        found.where("kept is not null").select(age, "key", "text", "kept").mapInArrow(_surroundings(length), "gram long, age long, key long, packed long, u binary")
        .repartition("gram").sortWithinPartitions("gram")
        .mapInArrow(_sorted_blocks(length), "key long, packed long, low long, high long")
        .groupBy("key").agg(F.collect_list(F.struct("packed", "low", "high")).alias("fresh"))
    )
    rows = found.join(fresh.hint("shuffle_hash"), "key", "left").drop("key")
    own = [f"c_{i}" for i in range(len(others))]
    fields = [hidden.schema["doc_id"], *[hidden.schema[c] for c in own], *[T.StructField(c, T.LongType()) for c in new[:3]], T.StructField("kept_sha256", T.StringType())]
    if keep:
        fields += [T.StructField("kept_bytes", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    out = rows.mapInArrow(_cut(["doc_id", *own], length, keep), T.StructType(fields))
    return show(out, ["doc_id"], others, new)
