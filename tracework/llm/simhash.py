"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint. A-Z is lower-cased, words are runs of non-separators, shingles
are ``words`` words in a row (fewer words: the whole sequence), joined by one
space, repeats included. Bit b of a document is 1 if it is set in more than
half of the shingles' XXH64 hashes (seed 42).

Links. Equal fingerprints are one node, so copies are never compared. The 64
bits are cut into ``blocks`` blocks; fingerprints within ``radius`` differing
bits agree on at least ``blocks - radius`` of them, so each fingerprint is sent
to one bucket for every such choice of blocks (15 buckets of 40 to 44 bits for
the default radius 2): no pair is lost and none is capped. Within a bucket the
comparison is bit-sliced: lane i holds the pair (i, i + d); the 64 bit planes are packed
vertically, XORed with themselves shifted by d, and summed by carry-save adders
into vertical counters; a block of lanes is abandoned once every lane in it has
left the radius. A task emits the links' spanning forest only.

Components are found by Spark joins (see :mod:`tracework.operators.components`) on fingerprints
and then mapped to the smallest doc_id.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; null doc_ids are kept and never serve as component_id unless nothing
else is there; repeated rows give repeated results; an empty table an empty one. Other columns stay but for
those with the name of a new one, in any case. A very long text is hashed whole, shingle by shingle.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components, roots_of
from .common import chunks, groups, hide, ranges, salted_join, show, utf8, whole_groups, written

SEED = 42
BLOCKS = 6
BUCKET_ROWS = 512
CHUNK_BYTES = 1 << 20
#: Candidates of resembling_groups: fingerprints of PRINT_WORDS 64-bit words within PRINT_RADIUS bits, of which PLANE_RADIUS at most lie in the first word.
PRINT_WORDS, PRINT_RADIUS, PLANE_RADIUS = 3, 56, 26
#: Sets of so few shingles reach a similarity of 0.8 with their equals only.
ALONE_SHINGLES = 3
#: The part of bits in which sets of similarity 0.8 differ at most (expected; any sizes): larger sets, and four shingles beside five.
DIFFER, DIFFER_FEW, FEW_SHINGLES = 0.1612, 0.1875, 5
#: Such a pair meets in no bucket with this probability at most.
MISSED = 1e-4
#: Fingerprints a bucket, by the number of bits that buckets fix; rows compared together.
PRINT_BUCKET, PRINT_ROWS = 1024, 1 << 16
TILE_SHINGLES = 1 << 18


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint of one text's UTF-8 bytes."""
    found = text.lower().split()
    return int(_majority(np.array(_hashes(found, words), np.uint64)).view(np.int64)) if found else 0


def _hashes(found: list[bytes], words: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Columns of docs (none named fp) but text, then fp (signed 64 bits)."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            raw, at = data.tobytes(), at.tolist()
            fps = [fingerprint(raw[a:b], words) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in others], pa.array(fps, pa.int64())], [*others, "fp"])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("fp", T.LongType())])
    return docs.select(*others, "text").mapInArrow(run, schema)


def _masks(radius: int, blocks: int) -> list[int]:
    """One mask for every choice of blocks - radius blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) uint64, the values' bits stored vertically: bit i of word w of plane b is bit b of values[64 w + i]; one spare word."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.zeros(((len(values) // 64 + 2) * 64, 64), np.uint8)
    rows[: len(values)] = bits
    return np.ascontiguousarray(np.packbits(rows, axis=0, bitorder="little").T).view(np.uint64)


def packed(flags: np.ndarray, words: int) -> np.ndarray:
    """Booleans as the bits of uint64 words."""
    every = np.zeros(words * 64, bool)
    every[: len(flags)] = flags
    return np.packbits(every, bitorder="little").view(np.uint64)


def near_lanes(left: np.ndarray, right: np.ndarray, shift: int, asked: np.ndarray, radius: int) -> np.ndarray:
    """The places i, among the bits set in ``asked``, where value i of left and value i + shift of right differ in at most ``radius`` bits.

    Planes are shifted and XORed, 64 lanes a word, and added into vertical
    counters by carry-save steps. After every eight planes the words (blocks of
    lanes) that are all beyond the radius are abandoned.
    """
    digits = max(1, int(radius).bit_length())
    word = np.flatnonzero(asked)
    over = ~asked[word]
    counters = [np.zeros(len(word), np.uint64) for _ in range(digits)]
    skip, bit = divmod(shift, 64)
    for plane in range(64):
        other = right[plane, word + skip] if not bit else right[plane, word + skip] >> np.uint64(bit) | right[plane, word + skip + 1] << np.uint64(64 - bit)
        carry = left[plane, word] ^ other
        for j in range(digits):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if radius + 1 < 1 << digits:  # a count above the radius that the digits can hold
            beyond = ~np.zeros_like(over)
            for j in range(digits):
                beyond &= counters[j] if (radius + 1) >> j & 1 else ~counters[j]
            over |= beyond
        if plane % 8 == 7:
            left_in = ~over != 0
            if not left_in.all():
                word, over, counters = word[left_in], over[left_in], [c[left_in] for c in counters]
            if not len(word):
                return word
    lanes = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
    row, lane = np.nonzero(lanes)
    return word[row] * 64 + lane


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Boolean per place: a[i] and b[i] (uint64) differ in at most ``radius`` bits."""
    left, right = bit_planes(a), bit_planes(b)
    out = np.zeros(len(a), bool)
    out[near_lanes(left, right, 0, packed(np.ones(len(a), bool), left.shape[1] - 1), radius)] = True
    return out


def bucket_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows, which are sorted by bucket; only rows of one bucket are compared, the planes are made once."""
    if len(fp) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = bit_planes(fp.view(np.uint64))
    left, right = [], []
    d = 0
    while True:
        d += 1
        same = bucket[d:] == bucket[:-d]
        if not same.any():
            break
        hit = near_lanes(planes, planes, d, packed(same, planes.shape[1] - 1 - d // 64), radius)
        left.append(fp[hit])
        right.append(fp[hit + d])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, root = roots_of(np.concatenate(left), np.concatenate(right))
    ok = nodes != root
    return nodes[ok], root[ok]


def _finer(mask: int, radius: int) -> list[int]:
    """The masks that take ``mask`` and all but ``radius`` of radius + 4 parts of the bits outside it."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = radius + 4
    parts = [sum(1 << b for b in free[round(i * len(free) / n) : round((i + 1) * len(free) / n)]) for i in range(n)]
    return [_signed((mask & (1 << 64) - 1) | sum(c)) for c in combinations(parts, n - radius)]


def _compare(radius: int, most: int | None):
    """Rows (bucket, mask, fp) sorted by bucket -> links (a, b), and the rows of buckets of over ``most`` rows as they are (again = mask)."""

    def solve(bucket, mask, fp):
        again = np.zeros(len(fp), bool)
        if most is not None and len(fp):
            _, number, n = np.unique(bucket, return_inverse=True, return_counts=True)
            again = n[number] > most
        a, b = bucket_links(bucket[~again], fp[~again], radius)
        kept, own = fp[again], mask[again]
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(a), pa.array(kept)]), pa.concat_arrays([pa.array(b), pa.nulls(len(kept), pa.int64())]), pa.concat_arrays([none, pa.array(own)])], ["a", "b", "again"]
        )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(c).to_numpy() for c in ("bucket", "mask", "fp"))
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
            if cut or (held and held[-1][0][-1] != rows[0][0]):
                done = [*held, tuple(x[:cut] for x in rows)]
                yield solve(*(np.concatenate(x) for x in zip(*done, strict=True)))
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _deal(rows: DataFrame, masks) -> DataFrame:
    """fp, masks (array) -> bucket, mask, fp, sorted by bucket within tasks."""
    dealt = rows.select("fp", F.explode(masks).alias("mask"))
    dealt = dealt.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "mask", "fp")
    return dealt.repartition("bucket").sortWithinPartitions("bucket")


def links(distinct: DataFrame, radius: int = 2, blocks: int = BLOCKS, most: int = BUCKET_ROWS) -> DataFrame:
    """fp (distinct) -> (a, b): links whose components are those of all pairs within the radius.

    A bucket of over ``most`` rows is dealt again by parts of the bits that it
    does not fix. With the default radius and blocks at most 2**8 rows agree on the bits of
    such a finer bucket, so no task compares many with many; no pair is lost at either level.
    """
    masks = _masks(radius, blocks)
    first = written(_deal(distinct, F.array(*[F.lit(m) for m in masks])).mapInArrow(_compare(radius, most), "a long, b long, again long"), "simhash-buckets")
    finer = F.lit(None).cast("array<long>")
    for m in masks:
        finer = F.when(F.col("mask") == F.lit(m), F.array(*[F.lit(x) for x in _finer(m, radius)])).otherwise(finer)
    large = first.where("again is not null").select(F.col("a").alias("fp"), F.col("again").alias("mask"))
    rest = _deal(large, finer).mapInArrow(_compare(radius, None), "a long, b long, again long")
    return first.where("again is null").unionByName(rest).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Columns of docs but text, then fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    hidden, others = hide(docs, ["doc_id", "text"], ["fingerprint", "component_id"])
    rows = written(fingerprints(hidden, words), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comp = components(links(nodes.select("fp"), radius, blocks), "simhash-links")
    classes = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    # A component may hold a large part of all fingerprints.
    named = salted_join(classes, lowest.withColumnRenamed("class", "l_class"), "class", "l_class", "fp").select(F.col("fp").alias("n_fp"), "component_id")
    out = salted_join(rows, named, "fp", "n_fp", "doc_id")
    return show(out, ["doc_id"], others, [F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"])


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[np.ndarray, int]:
    """(SimHash of the distinct shingles in PRINT_WORDS uint64 words, their number).

    The first word is voted by the shingles' XXH64 hashes, each further one by a mixture of them (splitmix64).
    """
    hashes = np.unique(np.array(_hashes(text.lower().split(), words), np.uint64))
    votes = np.empty((len(hashes), PRINT_WORDS), np.uint64)
    votes[:, 0] = hashes
    for k in range(1, PRINT_WORDS):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        votes[:, k] = x ^ x >> np.uint64(31)
    ones = np.zeros(64 * PRINT_WORDS, np.int64)
    for at in range(0, len(votes), 255):  # so many fit the sums' bytes
        ones += np.unpackbits(votes[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64), len(hashes)


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(node, text) -> node, f0, f1, f2 (its wide fingerprint), size (its shingles), a node once a task at least."""
    names = [f"f{k}" for k in range(PRINT_WORDS)]

    def run(batches):
        seen = set()
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            raw, at, node = data.tobytes(), at.tolist(), piece.column("node").to_pylist()
            new = {v: i for i, v in enumerate(node) if v not in seen}
            seen.update(new)
            found = [wide_fingerprint(raw[at[i] : at[i + 1]], words) for i in new.values()]
            prints = np.array([f for f, _ in found], np.uint64).view(np.int64).reshape(-1, PRINT_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.int64()), *map(pa.array, np.ascontiguousarray(prints.T)), pa.array([n for _, n in found], pa.int64())], ["node", *names, "size"]
            )

    return docs.select("node", "text").mapInArrow(run, f"node long, {', '.join(f'{n} long' for n in names)}, size long")


def bands_needed(bits: int, differ: float) -> int:
    """How many buckets of ``bits`` chosen bits a fingerprint needs, for a pair that differs in this part of bits to share one with probability 1 - MISSED."""
    n = 64 * PRINT_WORDS
    chance = np.array([comb(n, d) * differ**d * (1 - differ) ** (n - d) for d in range(n + 1)])
    apart = 1 - np.array([comb(n - d, bits) / comb(n, bits) for d in range(n + 1)])
    bands = 1
    # beyond the radius no bucket helps
    while (chance * apart**bands)[: PRINT_RADIUS + 1].sum() > MISSED:
        bands += 1
    return bands


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The differing bits of rows of uint64 words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def vertical_counts(planes: np.ndarray) -> list[np.ndarray]:
    """The binary digits, lowest first, of each lane's number of set planes: full adders on a third of the planes at once, carries go to the next digit."""
    digits = []
    while len(planes):
        carries = []
        while len(planes) > 1:
            third = max(1, len(planes) // 3)
            x, y = planes[:third], planes[third : 2 * third]
            either = x ^ y
            if len(planes) == 2:
                planes, carry = either, x & y
            else:
                z = planes[2 * third : 3 * third]
                planes, carry = np.concatenate([either ^ z, planes[3 * third :]]), x & y | either & z
            carries.append(carry)
        digits.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    return digits


def lanes_within(planes: np.ndarray, shift: int, asked: np.ndarray, radius: int) -> np.ndarray:
    """As ``near_lanes`` of planes with themselves, all planes at once: for radii so wide that most lanes stay to the end."""
    word = np.flatnonzero(asked)
    skip, bit = divmod(shift, 64)
    if 2 * len(word) > len(asked):  # slices are cheaper than picked words
        word, n = np.arange(len(asked)), len(asked)
        own, other, after = planes[:, :n], planes[:, skip : skip + n], planes[:, skip + 1 : skip + 1 + n]
    else:
        own, other, after = planes[:, word], planes[:, word + skip], planes[:, word + skip + 1]
    if bit:
        other = other >> np.uint64(bit) | after << np.uint64(64 - bit)
    near, equal = np.zeros(len(word), np.uint64), asked[word]
    digits = vertical_counts(own ^ other)
    for j in reversed(range(len(digits))):
        if radius >> j & 1:
            near |= equal & ~digits[j]
            equal = equal & digits[j]
        else:
            equal = equal & ~digits[j]
    place = np.flatnonzero(np.unpackbits((near | equal).view(np.uint8), bitorder="little").view(bool))
    return word[place >> 6] * 64 + (place & 63)


def print_links(bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (between first words) that span the components of all pairs of one bucket within the radii; rows are sorted by bucket.

    Rows near their bucket's first row are linked with it, every other row is compared with all after it: first words bit-sliced, the rest of those that this leaves by counts.
    """
    n = len(bucket)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.maximum.accumulate(np.where(np.concatenate([[True], bucket[1:] != bucket[:-1]]), np.arange(n), 0))
    near = distances(prints, prints[head]) <= PRINT_RADIUS
    first = prints[:, 0].view(np.int64)
    left, right = [first[near]], [first[head[near]]]
    by = np.lexsort((near, bucket))  # those still to be compared lead their buckets
    bucket, prints, first, near = bucket[by], prints[by], first[by], near[by]
    planes, columns = bit_planes(prints[:, 0]), list(np.ascontiguousarray(prints.T))
    held = d = 0
    while True:
        d += 1
        asked = (bucket[d:] == bucket[:-d]) & ~near[:-d]
        if not asked.any():
            break
        hit = lanes_within(planes, d, packed(asked, planes.shape[1] - 1 - d // 64), PLANE_RADIUS)
        hit = hit[sum(np.bitwise_count(f[hit] ^ f[hit + d]) for f in columns) <= PRINT_RADIUS]
        left.append(first[hit])
        right.append(first[hit + d])
        held += len(hit)
        if held > PRINT_ROWS:
            held, (a, b) = 0, roots_of(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    nodes, root = roots_of(np.concatenate(left), np.concatenate(right))
    ok = nodes != root
    return nodes[ok], root[ok]


def _print_links(batches):
    """Rows (bucket, f0, f1, f2) sorted by bucket -> links (a, b) of first words; whole buckets of about PRINT_ROWS rows stand together."""

    def solve(held):
        rows = pa.concat_batches(held)
        prints = np.stack([rows.column(f"f{k}").to_numpy() for k in range(PRINT_WORDS)], 1).view(np.uint64)
        a, b = print_links(rows.column("bucket").to_numpy(), prints)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, n = [], 0
    for rows in whole_groups(batches, "bucket"):
        held.append(rows)
        n += rows.num_rows
        if n >= PRINT_ROWS:
            yield solve(held)
            held, n = [], 0
    if held:
        yield solve(held)


def print_classes(docs: DataFrame, words: int = 5, most: int = PRINT_BUCKET) -> DataFrame:
    """(node, text) -> node (once each), class: the components of wide fingerprints within the radii.

    Buckets fix so many bits, chosen at random, that unlike fingerprints stand about ``most`` a bucket, and are as many as
    ``bands_needed`` says. Equal fingerprints are always in one class; up to ``most`` all are compared.
    """
    names = [f"f{k}" for k in range(PRINT_WORDS)]
    prints = written(_prints(docs, words).dropDuplicates(["node"]), "near-prints")
    distinct = written(prints.where(F.col("size") > ALONE_SHINGLES).groupBy(*names).agg(F.min("size").alias("size")), "near-distinct")
    bits = max(0, ceil(log2(max(1, distinct.count()) / most)))
    usual, few = bands_needed(bits, DIFFER), bands_needed(bits, DIFFER_FEW)
    rng = np.random.default_rng(SEED)
    masks = []
    for band in range(few):
        chosen = np.zeros(64 * PRINT_WORDS, bool)
        chosen[rng.choice(len(chosen), bits, replace=False)] = True
        masks.append((band, *np.packbits(chosen, bitorder="little").view(np.int64).tolist()))
    table = docs.sparkSession.createDataFrame(masks, f"band long, {', '.join(f'm{k} long' for k in range(PRINT_WORDS))}")
    dealt = distinct.crossJoin(F.broadcast(table)).where((F.col("band") < usual) | (F.col("size") <= FEW_SHINGLES))
    dealt = dealt.select(F.xxhash64("band", *[F.col(f).bitwiseAND(F.col(f"m{k}")) for k, f in enumerate(names)]).alias("bucket"), *names)
    links = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_print_links, "a long, b long")
    near = components(written(links.distinct(), "near-prints"), "near-classes").withColumnRenamed("node", "n_print")
    return prints.join(near, F.col("f0") == F.col("n_print"), "left").select("node", F.coalesce("root", "f0").alias("class"))


def _alike(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least this Jaccard similarity; one b may have many a."""

    def run(batches):
        last, x = None, set()
        for batch in (piece for batch in batches for piece in chunks([batch], "t", CHUNK_BYTES)):
            ok = []
            for b, s, t in zip(*(batch.column(c).to_pylist() for c in ("b", "s", "t")), strict=True):
                if b != last:
                    last, x = b, shingles(t, words)
                y = shingles(s, words)
                ok.append(len(x & y) >= least * len(x | y))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "s"), ("t_b", "t")))
    right = right.join(pairs.select(F.col("b").alias("t_b")).distinct(), "t_b", "left_semi")
    return salted_join(pairs.join(left, "a"), right, "b", "t_b", "a").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """node, text -> node, set (its distinct shingles' hashes)."""

    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            raw, at = data.tobytes(), at.tolist()
            sets = [np.unique(np.array(_hashes(raw[a:b].lower().split(), words), np.uint64)).view(np.int64) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def alike_in_tile(sets: pa.Array, second: np.ndarray, own: np.ndarray, root: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of different components with at least this Jaccard similarity, joining each two components once.

    Rows with ``own`` are compared with one another, others only across ``second``.
    An inverted index of the shingles gives a row's overlaps with all rows after it in one count.
    """
    size = np.diff(sets.offsets.to_numpy())
    n = len(size)
    _, term = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    by = np.argsort(term, kind="stable")
    posting, n_terms = owner[by], int(term.max(initial=-1)) + 1
    head = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
    at = np.concatenate([[0], np.cumsum(size)])
    label = root.copy()
    left, right = [], []
    for i in range(n - 1):
        terms = term[at[i] : at[i + 1]]
        count = head[terms + 1] - head[terms]
        overlap = np.bincount(posting[np.repeat(head[terms], count) + ranges(count)], minlength=n)[i + 1 :]
        j = np.flatnonzero(overlap >= least * (size[i] + size[i + 1 :] - overlap)) + i + 1
        j = j[(label[j] != label[i]) & ((own[i] & own[j]) | (second[i] != second[j]))]
        for other in np.unique(label[j]).tolist():
            left.append(i)
            right.append(int(j[label[j] == other][0]))
            label[label == other] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _tile_links(least: float):
    """Rows (tile, second, own, node, root, set) sorted by tile -> links (a, b) between nodes."""

    def solve(rows: pa.RecordBatch):
        sets = rows.column("set")
        flags = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("second", "own", "root"))
        i, j = alike_in_tile(sets, *flags, least)
        return pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(i)), rows.column("node").take(pa.array(j))], ["a", "b"])

    def run(batches):
        for rows in groups(batches, "tile"):
            yield solve(rows)

    return run


def resembling_groups(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, node, rows, keep: one row a (doc_id, node) whose component has more rows; keep is true for one of the component's.

    Equal texts are one node (the 64-bit ``text_node``). Candidates are the nodes of one class of ``print_classes``: SimHash
    fingerprints within a radius, compared bit-sliced. Each is compared by exact Jaccard similarity of word shingles
    with its class's smallest node; then the others of a class that this leaves in
    different components are compared in tiles of about ``TILE_SHINGLES`` by ``TILE_SHINGLES``, by an inverted
    index of their shingles' hashes: no pair is written, only links that join components. So the components are those of all
    candidate pairs with the similarity, whatever doc_ids they have. The
    smallest doc_id of a component is kept, a null one only if there is no other.
    The radii and numbers of buckets are those for a similarity of 0.8 or more.
    """
    keys = written(docs.groupBy("doc_id", text_node().alias("node")).agg(F.count(F.lit(1)).alias("rows")), "near-keys")
    lows = keys.groupBy("node").agg(F.min("doc_id").alias("low"))
    classed = written(print_classes(docs.select(text_node().alias("node"), "text"), words), "near-classes")
    several = classed.groupBy("class").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("bucket"), "b")
    shared = written(salted_join(classed, several, "class", "bucket", "node").select("bucket", "node", "b"), "near-shared")
    named = lows.join(shared.select("node"), "node").select(F.col("node").alias("t_node"), "low")
    rows = docs.select("doc_id", text_node().alias("node"), "text")
    texts = written(rows.join(named.hint("shuffle_hash"), (F.col("node") == F.col("t_node")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("node", "text").dropDuplicates(["node"]), "near-texts")
    first = written(_alike(shared.where("node <> b").select(F.col("node").alias("a"), "b"), texts, least, words), "near-links")
    root = components(first, "near-first")
    placed = shared.join(root, "node", "left").select("bucket", "node", "b", F.coalesce("root", "node").alias("root"))
    # Pairs with the smallest are decided; a bucket has more to compare if its other nodes lie in several components.
    rest = placed.where("node <> b").select("bucket", "node", "root")
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    open_ = written(rest.join(mixed, "bucket"), "near-open")
    sets = written(_hashed(texts.join(open_.select("node").distinct(), "node"), words), "near-sets")
    sized = open_.join(sets.select("node", F.size("set").alias("size")), "node")
    parts = sized.groupBy("bucket").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("parts"))
    # A node meets every part of its bucket in one tile: (own part, other part), the lower first.
    tiles = open_.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), (F.col("part") > F.col("other")).alias("second"), (F.col("part") == F.col("other")).alias("own"), "node", "root")
    found = tiles.join(sets, "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links(least), "a long, b long")
    links = first.unionByName(written(found.distinct(), "near-links"))
    comp = components(links, "near-links")
    classes = keys.join(comp, "node", "left").select("doc_id", "node", "rows", F.coalesce("root", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = classes.groupBy("class").agg(F.min(order).alias("best"), F.sum("rows").alias("all")).where(F.col("all") > 1).withColumnRenamed("class", "b_class")
    return salted_join(classes, best, "class", "b_class", "node").select("doc_id", "node", "rows", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).__and__(F.col("node") == F.col("best.node")).alias("keep"))


def text_node():
    return F.xxhash64(F.coalesce("text", F.lit("")))
