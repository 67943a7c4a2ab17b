"""The numbered operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import io
import json
import random
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracework.llm import common, language_id, media, mixing, neighbours, packing, quality, queries, simhash, suffix_dedup, token_counts, warc
from tracework.operators import components

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, score string, length int, rank int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 7]) for i in range(20)]
    rows += [(200 + i, base[i] + "\n" + passage + " " + base[i + 1][:50]) for i in range(10)]
    rows += [(300, None), (301, ""), (302, "   \t\n"), (303, "x"), (304, "a" * 700), (305, "ab " * 400), (306, "!!! 123 ..."), (307, "\x01\x00z" * 50)]
    rows += [(400, passage.upper()), (401, "word " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns whose names the operators use themselves, and one repeated row."""
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", f"s{i % 3}" if i % 11 else None, None if t is None else len(t), 1, "q", "w", 5, 6) for i, t in texts]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# suffix-array dedup


def brute_dedup(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 101, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                mark[s] += 1
                mark[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(docs, texts):
    rows = suffix_dedup.dedup(docs, keep=True).collect()
    expected = brute_dedup(texts)
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) == expected[r.doc_id], r.doc_id
    assert sum(r.n_removed > 0 for r in rows) > 25


def test_suffix_dedup_same_doc_id_and_null_doc_id(spark):
    rng = random.Random(1)
    a, b = words(rng, 80), words(rng, 80)
    rows = suffix_dedup.dedup(spark.createDataFrame([(None, a), (5, a), (5, b), (6, b)], "doc_id long, text string")).collect()
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in rows}
    assert found[None, len(a.encode())] == 0 and found[5, len(a.encode())] == len(a.encode())
    assert found[5, len(b.encode())] == 0 and found[6, len(b.encode())] == len(b.encode())


@pytest.mark.parametrize("hot", [1, 10**9])
def test_suffix_dedup_of_hot_grams(docs, texts, monkeypatch, hot):
    """hot = 10**9: every repeated k-gram counts as hot; hot = 1: none does."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    expected = brute_dedup(texts)
    for r in suffix_dedup.dedup(docs, keep=True).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) == expected[r.doc_id], r.doc_id


def test_suffix_dedup_rows_of_one_id_with_equal_checksums(spark):
    """Two texts of one doc_id whose 16-bit checksums are equal stay apart."""
    rng = random.Random(2)
    passage = words(rng, 60)
    a = words(rng, 40) + " " + passage
    want = zlib.crc32(a.encode()) & 0xFFFF
    b = next(t for t in (f"{words(rng, 20)} {i}" for i in range(10**7)) if zlib.crc32(t.encode()) & 0xFFFF == want)
    expected = brute_dedup([(0, passage), (1, a)])
    rows = suffix_dedup.dedup(spark.createDataFrame([(0, passage), (1, a), (1, b)], "doc_id long, text string")).collect()
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in rows}
    assert found[1, len(a.encode())] == expected[1][1] > 0 and found[1, len(b.encode())] == 0


def test_suffix_dedup_many_rows_without_id(spark):
    rng = random.Random(4)
    passage = words(rng, 40)
    rows = [(None, f"{words(rng, 10)} {passage} {i}") for i in range(1000)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(passage.encode())
    assert len(got) == 1000 and sum(r.n_removed == 0 for r in got) == 1 and min(sorted(r.n_removed for r in got)[1:]) >= n


def test_anchors_in_windows_cover_every_string():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    whole, cut = (suffix_dedup.anchors_in_windows(data, np.array([0, 5000]), window=w) for w in (10**6, 300))
    spread = lambda a: sorted((s + j, p - j, g) for _, s, n, p, g in zip(*a, strict=True) for j in range(n))
    assert spread(whole) == spread(cut)


def test_multikey_quicksort_parts_by_prefix():
    rng = random.Random(11)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    length = np.array([len(x) for x in strings])
    buffer = np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8)
    order, border = suffix_dedup.multikey_quicksort(buffer, np.cumsum(length) - length, length, np.zeros(500, np.int64), 16)
    got = [strings[i] for i in order]
    for a, b, depth in zip(got, got[1:], border[1:]):
        if depth == 16:
            assert a[:16] == b[:16]
        else:
            assert a[:depth] == b[:depth] and a[depth : depth + 8] < b[depth : depth + 8]


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.dedup(empty).collect() == []


@pytest.mark.parametrize("shallow", [0, 8, 32])
def test_deep_shallow_orders_like_sorted(shallow):
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    strings += [b"ab" * rng.randint(1, 40) for _ in range(100)]
    group = np.sort(np.array([rng.randint(0, 5) for _ in strings]))
    length = np.array([len(s) for s in strings])
    start = np.cumsum(length) - length
    buffer = np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8)
    order, common_ = suffix_dedup.deep_shallow(buffer, start, length, group, shallow)
    got = [(group[i], strings[i]) for i in order]
    assert got == sorted(got)
    for j in range(1, len(got)):
        if group[order[j]] == group[order[j - 1]]:
            assert common_[j] == suffix_dedup.BlindTrie.common(got[j - 1][1], got[j][1])
        else:
            assert common_[j] == -1


# SimHash


def brute_simhash(text, n=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[j : j + n]) for j in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, texts):
    fps = {i: brute_simhash(t) for i, t in texts}
    classes = brute_classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == classes[r.doc_id]


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distance(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    flips = np.zeros_like(a)
    for _ in range(6):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64) * (rng.random(len(a)) < 0.5).astype(np.uint64)
    expected = np.array([int(x).bit_count() <= radius for x in flips])
    assert (simhash.within(a, a ^ flips, radius) == expected).all()


def test_links_lose_no_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            fps.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)
    found = {r.node: r.root for r in components.components(links).collect()}
    classes = brute_classes(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: found.get(i, i) for i in signed} == classes


def test_large_buckets_are_dealt_again_and_lose_no_pair(spark):
    """400 fingerprints that agree on 43 bits: one bucket, far over the limit given."""
    rng = random.Random(6)
    base = rng.getrandbits(43) << 21
    fps = sorted({base | rng.getrandbits(21) for _ in range(400)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, most=16)
    found = {r.node: r.root for r in components.components(links).collect()}
    classes = brute_classes(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: found.get(i, i) for i in signed} == classes


@pytest.mark.parametrize("shift", [0, 1, 63, 64, 65, 200])
def test_shifted_planes(shift):
    rng = np.random.default_rng(shift)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    a[shift::7] = a[: len(a[shift::7])] if not shift else a[: len(a) - shift : 7] ^ np.uint64(1 << 40)
    planes = simhash.bit_planes(a)
    got = simhash.near_lanes(planes, planes, shift, simhash.packed(np.ones(500 - shift, bool), planes.shape[1] - 1 - shift // 64), 2)
    assert sorted(got) == [i for i in range(500 - shift) if int(a[i] ^ a[i + shift]).bit_count() <= 2]


def test_alike_in_tile_is_brute_force():
    import pyarrow as pa

    rng = random.Random(8)
    base = [rng.sample(range(1000), 40) for _ in range(4)]
    sets = [sorted({x if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.randrange(1000) for x in rng.choice(base)}) for _ in range(120)]
    n = len(sets)
    for second, own in ((np.zeros(n, bool), np.ones(n, bool)), (np.arange(n) % 2 > 0, np.zeros(n, bool))):
        i, j = simhash.alike_in_tile(pa.array(sets, pa.list_(pa.int64())), second, own, np.arange(n), 0.8)
        near = lambda a, b: (own[a] or second[a] != second[b]) and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})  # noqa: B023, E731
        expected = brute_classes(list(range(n)), near)
        got = brute_classes(list(range(n)), lambda a, b: (a, b) in {*zip(i.tolist(), j.tolist(), strict=True)})  # noqa: B023
        assert got == expected


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3)]
    random.Random(0).shuffle(pairs)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    for i in range(300):
        assert found.get(i, i) == i // 50 * 50
    assert all(found[i] == 1000 for i in range(1001, 1200))


@pytest.mark.parametrize("pieces", [1, 8])
def test_components_deal_only_nodes_that_change(spark, monkeypatch, pieces):
    """However many tasks the links lie in: leaves and roots are not repeated for several tasks, and finished stars need no round."""
    dealt, plain = [], components.salted
    monkeypatch.setattr(components, "salted", lambda rows, table, *more: dealt.append(table.count()) or plain(rows, table, *more))
    stars = [(10 * k, 10 * k + i) for k in range(300) for i in range(1, 5)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(pieces)
    assert {r.node: r.root for r in components.components(table(stars)).collect()} == {b: a for a, b in stars}
    assert not dealt
    bridges = [(3, 12), (104, 201), (203, 300), (2990, 2992)]
    root = {b: a for a, b in stars} | {i: 0 for i in range(1, 15) if i % 10 < 5} | {i: 100 for i in range(101, 305) if i // 10 in (10, 20, 30) and i % 10 < 5}
    assert {r.node: r.root for r in components.components(table([*stars, *bridges])).collect()} == root
    assert sum(dealt) <= 20


# packing


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    total = 0
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        at = 0
        for n, (_, start, length, crc) in enumerate(pieces):
            assert start == at and zlib.crc32(ids[at : at + length]) == crc and (n == 0 or length == 2048)
            at += length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_encoder_has_the_ids_of_tokenizers(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [t for _, t in texts if t] + ["a<|endoftext|>b", "<|endoftext|> x", " <|endoftext|><|endoftext|>\n", "<|endoftext", "日本語 ٣ ü̈", "  \n\n  tabs\t\t", "don't I'LL 1234567", "\x00\x7f\xa0\xad"]
    some += [r.text for r in common.read_table(spark, sf_dir, "documents").select("text").collect()]
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(some) == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(["a<|endoftext|>b"]) == [[64, 50256, 65]]


def test_plan_beats_next_fit_and_uses_everything():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 2049, 400)
    values, counts = np.unique(lengths, return_counts=True)
    bins = packing.plan(values, counts, 2048)
    used = sorted(x for times, items in bins for x in items * times)
    assert used == sorted(lengths.tolist()) and all(sum(items) <= 2048 for _, items in bins)


def test_pair_that_fits_is_the_best():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lengths = np.sort(rng.choice(np.arange(1, 60), 12, replace=False))[::-1]
        counts = rng.integers(0, 3, 12)
        room, over = int(rng.integers(5, 100)), int(rng.integers(0, 40))
        items = [x for x, c in zip(lengths, counts, strict=True) for _ in range(c)]
        sums = [items[i] + items[j] for i in range(len(items)) for j in range(i) if over < items[i] + items[j] <= room]
        got = packing.two_that_fit(lengths, counts, room, over)
        assert (sum(got) if got else None) == (max(sums) if sums else None)


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


# mixing


def water_level(sizes, weights, total):
    """Reshare the excess by weight until none is above its cap."""
    target = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), total
    while free and left > 1e-9:
        whole = sum(weights[s] for s in free)
        over = 0.0
        for s in list(free):
            target[s] += left * weights[s] / whole
        for s in list(free):
            if target[s] >= 2 * sizes[s] - 1e-12:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
        left = over
    return target


def test_mixing(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == len(texts) + 1
    import re

    body = dict(texts)
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", body[r.doc_id] or ""))
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])


def test_source_targets_reshare(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 50, 5000]) for i in range(rng.randint(1, 9))} | {None: 3}
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        expected = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
        for r in rows:
            assert abs(r.target - expected[r.source]) < 1e-6


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 17, 400):
        votes = [(1, i, float(rng.randint(0, 1000))) for i in range(12)]
        rows = mixing.sainte_lague(spark.createDataFrame(votes, "all int, k int, votes double"), ["all"], ["k"], F.lit(seats)).collect()
        quota = {k: 0 for _, k, _ in votes}
        for _ in range(seats):
            best = max(votes, key=lambda v: (v[2] / (2 * quota[v[1]] + 1), -v[1]))
            quota[best[1]] += 1
        assert {r.k: r.quota for r in rows} == quota


def test_mixing_in_regions(spark, monkeypatch):
    """Many regions of few small shards; the last block of a shard is only partly filled, so a shard may miss up to a block."""
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    rows = [(i, "w " * (i % 13), "ab"[i % 2], 1) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, block int"), block=2).collect()
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.05 * own[0].target and all(r.taken <= 2 * r["size"] for r in own)


def test_mixing_without_ids(spark):
    rows = [(None, f"word {i}", "s") for i in range(1000)]
    a, b = (mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect() for n in (3, 5))
    assert sorted((r.text, r.taken) for r in a) == sorted((r.text, r.taken) for r in b) and len(a) == 1000


INTERNAL = "key gram packed kept fresh age fp mask bucket n_fp node low block quota n end shard region content h length piece p_best text_ c_0 c_1 hot feature media block_ Score".split()


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op7", "op8"])
def test_columns_with_internal_names_stay(spark, name):
    rows = [(i, f"some words of text {i % 5}", "en" if i % 2 else "fr", "s", *range(len(INTERNAL))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in INTERNAL))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    apply = {"op1": lambda d: quality.classify(d, labels), "op2": suffix_dedup.dedup, "op4": language_id.predict, "op7": simhash.near_duplicates, "op8": mixing.mix}[name]
    out = apply(docs)
    new = {"op1": {"Score"}, "op4": {"Score"}}.get(name, set())
    got = out.collect()
    assert len(got) == 30 and set(INTERNAL) - new <= set(out.columns)
    assert all(r[c] == i for r in got for i, c in enumerate(INTERNAL) if c not in new)


def test_mixing_empty(empty):
    assert mixing.mix(empty).collect() == []


# language ID


def test_language_id_held_out(spark, sf_dir):
    rows = queries.op4_language_id(spark, sf_dir)
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and 0 <= held[1] and held[2] <= 1
    crc = rows.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in crc)


def test_language_id_cases(docs, empty):
    rows = {r.doc_id: r for r in language_id.predict(docs).collect()}
    for i in (300, 301, 302, 306):
        assert rows[i].lang_pred == "und" and rows[i].score == 0
    assert rows[0].lang_pred in ("en", "fr")
    assert language_id.predict(empty).collect() == []


@pytest.mark.parametrize("window", [1, 2, 3, 100])
def test_ngrams_stay_in_their_row(window):
    text = "äbc" + "" + "zäbc"
    points, at = common.code_points(np.frombuffer(text.encode(), np.uint8), np.array([0, 4, 4, 9]))
    assert points.tolist() == list(map(ord, text)) and at.tolist() == [0, 3, 3, 7]
    found = list(language_id.ngram_buckets(points, at, window))
    buckets, rows = (np.concatenate(x) for x in zip(*found))
    assert np.bincount(rows, minlength=3).tolist() == [3 + 2 + 1, 0, 4 + 3 + 2 + 1]
    assert set(buckets[rows == 0]) <= set(buckets[rows == 2])


def brute_language(train, texts):
    """Multinomial posterior with plain dictionaries over the operator's own bucket rule."""

    def grams(text):
        t = [ord(c) for c in text.lower()]
        for n in (1, 2, 3, 4):
            for i in range(len(t) - n + 1):
                code = 0
                for c in t[i : i + n]:
                    code = (code * 0x01000193 + c + 1) & 0xFFFFFFFF
                yield ((code ^ n * 40503) * 2654435761 & 0xFFFFFFFF) >> 16

    counts, docs = {}, {}
    for lang, text in train:
        docs[lang] = docs.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for g in grams(text):
            own[g] = own.get(g, 0) + 1
    out = []
    for text in texts:
        joint = {}
        for lang, own in counts.items():
            whole = sum(own.values()) + 0.5 * language_id.BUCKETS
            joint[lang] = np.log(docs[lang] / len(train)) + sum(np.log((own.get(g, 0) + 0.5) / whole) for g in grams(text))
        best = max(sorted(joint), key=joint.get)
        out.append((best, 1 / sum(np.exp(v - joint[best]) for v in joint.values())))
    return out


@pytest.mark.parametrize("block", [1, 2, 64])
def test_language_id_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "LANGS", block)
    rng = random.Random(5)
    alphabet = {"aa": "abcdeÀ", "bb": "cdefgh", "cc": "жзик ё", "dd": "abcxyz"}
    text = lambda lang, n: "".join(rng.choice(alphabet[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 60)), lang) for i in range(160) for lang in [rng.choice(list(alphabet))]]
    rows += [(1000 + i, text("aa", 3) + text("dd", 3), None) for i in range(30)]
    found = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    train = [(lang, t) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    expected = brute_language(train, [t for _, t, _ in rows])
    for (i, t, _), (lang, score) in zip(rows, expected, strict=True):
        if any(map(str.isalpha, t)):
            assert found[i].lang_pred == lang and abs(found[i].score - score) < 1e-3


def test_language_id_of_many_languages(spark):
    rows = [(i, f"x{i}y" * 3, f"l{i:03}") for i in range(600)]
    found = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 600 and {r.lang_pred for r in found} <= {r[2] for r in rows}
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in found if not r.held_out) > 400


# quality


def test_quality_held_out(spark, sf_dir):
    rows = queries.op1_quality_classifier(spark, sf_dir).join(common.read_table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert wins > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_vote_is_brute_force():
    rng = np.random.default_rng(7)
    learn, ask = rng.random((90, quality.DIM)).astype(np.float32), rng.random((40, quality.DIM)).astype(np.float32)
    learn[60:] = learn[:30]  # ties
    ask[0] = 0
    y = rng.integers(0, 2, 90)
    model = quality.Model(learn.copy(), y, neighbours=7, power=3.0)
    near = model.project(ask) @ model.vectors.T
    for x, row, got in zip(ask, near, model.score(ask), strict=True):
        if not x.any():
            assert abs(got - y.mean()) < 1e-6
            continue
        best = sorted(range(90), key=lambda i: (-row[i], i))[:7]
        weight = [max(float(row[i]), 0.0) ** 3 for i in best]
        assert abs(got - sum(w * y[i] for w, i in zip(weight, best, strict=True)) / sum(weight)) < 1e-5
    for v, row in zip(model.project(ask), near, strict=True):
        assert np.allclose(row, [sum(float(a) * float(b) for a, b in zip(v, w, strict=True)) for w in model.vectors], atol=1e-5)


def test_words_and_layout_are_terms():
    texts = [b"alpha beta gamma.", b"delta omega sigma.", b"alpha beta gamma."]
    x = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    layout, words_ = x[:, : quality.SYMBOL_TERMS], x[:, quality.SYMBOL_TERMS :]
    assert (layout[0] == layout[1]).all() and (words_[0] != words_[1]).any() and (x[0] == x[2]).all()


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.score for r in rows}
    assert by[300] == by[301] and 0 <= by[300] <= 1
    assert quality.classify(empty, labels).collect() == []
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


# token counts


def test_token_counts(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = set(token_counts.vocabulary(path))
    longest = max(map(len, tokens))

    def greedy(word):
        symbols, n, at = (*word, token_counts.END), 0, 0
        while at < len(symbols):
            end = next((e for e in range(min(len(symbols), at + longest), at, -1) if symbols[at:e] in tokens), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    rows = token_counts.count_tokens(docs, path).collect()
    expected = {i: [greedy(w) for w in (t or "").encode().lower().split()] for i, t in texts}
    for r in rows:
        assert (r.n_words, r.n_tokens) == (len(expected[r.doc_id]), sum(expected[r.doc_id]))


def test_automaton_of_small_vocabularies():
    rng = random.Random(8)
    for _ in range(60):
        tokens = {tuple(rng.choice(b"ab") for _ in range(rng.randint(1, 5))) + ((256,) if rng.random() < 0.4 else ()) for _ in range(rng.randint(1, 12))}
        machine = token_counts.Automaton(sorted(tokens))
        for _ in range(40):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12)))
            symbols, n, at = (*word, 256), 0, 0
            while at < len(symbols):
                end = next((e for e in range(len(symbols), at, -1) if symbols[at:e] in tokens), None)
                if end is None:
                    n, at = 1, len(symbols)
                else:
                    n, at = n + 1, end
            assert machine.count(word) == n, (tokens, word)


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", "x" * 999), (10, "u", "x" * 999), (None, "u", other), (9, None, big), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 80)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_warc_round_trip(pages):
    rows = warc.round_trip(pages).collect()
    source = pages.collect()
    assert len(rows) == len(source)
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    latest = {}
    for p in source:
        if len((p.html or "").encode()) >= 1000 and p.page_id is not None:
            latest[digest(p.html)] = max(latest.get(digest(p.html), 0), p.page_id)
    expected = sorted((str(p.page_id), len((p.html or "").encode()), digest(p.html), *((("response", "None")) if latest.get(digest(p.html), p.page_id) == p.page_id else ("revisit", str(latest[digest(p.html)])))) for p in source)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows) == expected


def test_warc_payloads_and_empty(spark, pages):
    folder = common.new_folder(spark, "warc-test")
    rows = warc.read_archives(warc.write_archives(pages, folder)).collect()
    html = {p.page_id: p.html for p in pages.collect()}
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) == (html[r.page_id] or "").encode()
    assert warc.round_trip(pages.where("false")).collect() == []


def test_zip_directories_and_zip64():
    for n in (3, 66_000):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
            for i in range(n):
                z.writestr(f"m{i}", f"data {i}")
        raw = buffer.getvalue()
        read = lambda at, size: raw[at : at + size]  # noqa: B023, E731
        members = warc.directory(read, len(raw))
        assert len(members) == n
        m = members[f"m{n - 1}"]
        assert read(warc.stored_at(read, m), m.size) == f"data {n - 1}".encode()


def test_compressed_members_are_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    raw = buffer.getvalue()
    read = lambda at, size: raw[at : at + size]
    with pytest.raises(ValueError, match="stored"):
        warc.stored_at(read, warc.directory(read, len(raw))["a"])


# nearest neighbours


def brute_neighbours(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % 50 == 0]:
        score = unit @ (ok[q] / np.linalg.norm(ok[q]))
        best = sorted((-round(s, 9), i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[int(q)] = [int(i) for _, i in best]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(2500)]
    hot = rng.standard_normal(16).tolist()
    rows += [(3000 + i, hot) for i in range(900)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [1.0] * 15 + [None]), (5150, [1.0] * 15 + [float("nan")]), (5200, [float("inf")] + [1.0] * 15), (5250, [1.0] * 3), (None, hot)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    expected = brute_neighbours([(i, None if v is None else np.float32(v).tolist() if None not in v else v) for i, v in rows])
    assert set(found) == set(expected)
    hit = total = 0
    for q, best in expected.items():
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        if 3000 <= q < 3900:
            assert [found[q][r][0] for r in range(1, 6)] == best
        hit += len({i for i, _ in found[q].values()} & set(best))
        total += len(best)
    assert hit / total >= 0.9


def test_descent_raises_the_recall_of_the_graph(spark):
    """Links found before and after each round, on unclustered vectors; no query lacks neighbours."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[::50] *= 1e-170  # squares of these vanish
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = common.written(neighbours.nodes_of(neighbours.usable(df), 6), "test-nodes")
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    true = {i: set(np.argsort(-sim[i])[:5].tolist()) for i in range(3000)}
    recall = []

    def report(graph):
        found = {}
        for r in graph.collect():
            found.setdefault(r.v, set()).add(r.w)
        assert len(found) == 3000
        recall.append(sum(len(true[i] & found[i]) for i in true) / 15000)

    neighbours.build_graph(nodes, 3000, 16, report=report)
    assert recall[0] < 0.6 and recall[-1] > 0.85 and all(b >= a for a, b in zip(recall, recall[1:]))
    rows = neighbours.nearest(df, lambda c: c % 50 == 0).collect()
    assert len(rows) == 5 * 60 and np.mean([r.vec_id in true[r.query_id] for r in rows]) >= 0.95
    assert all(abs(r.score - sim[r.query_id, r.vec_id]) < 1e-12 for r in rows)


def test_local_join_is_all_pairs_with_a_new_link():
    rng = np.random.default_rng(4)
    u = np.repeat([3, 5, 9], [4, 1, 6])
    w, old, x = rng.permutation(100)[:11], rng.random(11) < 0.5, rng.standard_normal((11, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v, other, sim = neighbours.local_join(u, w, old, np.full(11, -2, np.float32), x, 50)
    expected = {(w[i], w[j]) for i in range(11) for j in range(11) if i != j and u[i] == u[j] and not (old[i] and old[j])}
    assert {*zip(v.tolist(), other.tolist(), strict=True)} == expected


def test_neighbours_of_few(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (7, [0.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 50 == 0).collect() == []


# media


def test_media_round_trip(docs, texts):
    rows = media.decode_column(media.encode_column(docs), digest=True).collect()
    body = dict(texts)
    by_text = {}
    assert len(rows) == len(texts) + 1
    for r in rows:
        raw = (body[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_media_any_bytes_and_batches():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 63, 64, 65, 384, 385, 5000, 40_000)] + [bytes([1]) * 700, bytes([255]) * 700, b""]
    data = np.frombuffer(b"".join(rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    files = media.encode(data, at)
    frames, where, coefs = media.decode(files)
    for raw, own in zip(rows, where, strict=True):
        n = max(64, -(-len(raw) // 64) * 64)
        got = media.BYTE[coefs[own[0][0] : own[0][0] + n // 64] + 128].tobytes()
        assert got == raw + b"\0" * (n - len(raw))
    assert media.encode(data[at[4] : at[5]], np.array([0, 384])) == [files[4]]


def test_media_of_long_payloads_in_parts(spark, monkeypatch):
    monkeypatch.setattr(media, "PART_BYTES", 640)
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abc é\n") for _ in range(n)) for i, n in enumerate((0, 639, 640, 641, 1280, 20_000))}
    stored = media.encode_column(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for r in media.decode_column(stored).collect():
        raw = texts[r.doc_id].encode()
        assert bytes(r.payload) == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert len(r.rgb) == r.height * r.width * 3
    files = [r.media for r in stored.collect()]
    assert [len(list(media._parts(bytes(f)))) for f in files][1:4] == [-(-len(texts[i].encode()) // 640) for i in (1, 2, 3)]


def test_media_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z", 3)], "doc_id long, text string, feature string, media string, rgb string, payload_bytes int")
    row = media.decode_column(media.encode_column(docs), digest=True).first()
    assert row.payload_bytes == 64 and row.rgb == "z" and row.feature.startswith("16x16:")
    assert media.decode_column(media.encode_column(docs)).first().payload_bytes == 3


def hand_made_jpeg(coefs):
    """One grey 8 x 16 picture (two blocks) by another rule than the module's: a bit at a time, its own tables, bands 1-20 and 21-63 with
    successive approximation of two bits, an end-of-band run over both blocks, a zero run of 16 in a refinement."""
    bits = []
    put = lambda code: bits.extend(code)

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def flush():
        while len(bits) % 8:
            bits.append("1")
        raw = bytes(int("".join(bits[i : i + 8]), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits.clear()
        return raw

    symbols = [0x00, 0x10, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 8)]  # all of 8 bits
    code = {s: f"{i:08b}" for i, s in enumerate(symbols)}
    dht = lambda kind, own: segment(0xC4, bytes([kind, *[0] * 7, len(own), *[0] * 8, *own]))

    def magnitude(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def shifted(v, low):
        return (abs(v) >> low) * (1 if v > 0 else -1)

    def sos(first, last, high, low):
        return segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low]))

    out = b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC2, (8).to_bytes(1, "big") + (8).to_bytes(2, "big") + (16).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    out += dht(0x00, list(range(12))) + dht(0x10, symbols)
    before = 0
    for block in coefs:
        n, extra = magnitude(block[0] - before)
        put(f"{n:08b}" + extra)
        before = block[0]
    out += sos(0, 0, 0, 0) + flush()
    for first, last in ((1, 20), (21, 63)):
        values = [[shifted(c, 2) for c in block[first : last + 1]] for block in coefs]
        if not any(map(any, values)):
            put(code[0x10] + "0")  # a run of two blocks
        else:
            for own in values:
                run = 0
                for v in own:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        put(code[0xF0])
                        run -= 16
                    n, extra = magnitude(v)
                    put(code[run << 4 | n] + extra)
                    run = 0
                if run:
                    put(code[0x00])
        out += sos(first, last, 0, 2) + flush()
    for low in (1, 0):
        for first, last in ((1, 20), (21, 63)):
            for block in coefs:
                run, pending = 0, ""
                own = block[first : last + 1]
                news = [k for k, c in enumerate(own) if abs(c) >> low == 1]
                for k, c in enumerate(own):
                    a = abs(c) >> low
                    if a == 0:
                        run += 1
                        continue
                    while run > 15 and news and k <= news[-1]:
                        put(code[0xF0] + pending)
                        run, pending = run - 16, ""
                    if a > 1:
                        pending += str(a & 1)
                        continue
                    put(code[run << 4 | 1] + ("1" if c > 0 else "0") + pending)
                    run, pending = 0, ""
                if run or pending:
                    put(code[0x00] + pending)
            out += sos(first, last, low + 1, low) + flush()
    return out + b"\xff\xd9"


def test_decoder_reads_a_hand_made_file():
    rng = random.Random(21)
    for case in range(12):
        coefs = [[rng.randint(-90, 90)] + [rng.choice([0] * (1 + 3 * (case % 5)) + [rng.randint(-60, 60)]) for _ in range(63)] for _ in range(2)]
        if case % 3 == 0:
            for block in coefs:
                block[21:] = [rng.choice([0, 0, 1, -1, 3]) for _ in range(43)]
        if case % 4 == 0:
            coefs[0][1:21] = [5, *[0] * 17, 1, 9]
        _, where, got = media.decode([hand_made_jpeg(coefs)])
        assert got[where[0][0][0] : where[0][0][0] + 2].tolist() == coefs, case


def reference_idct(block):
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return basis @ block @ basis.T


def test_inverse_transform_and_colour():
    rng = np.random.default_rng(1)
    coefs = rng.integers(-60, 60, (50, 64))
    got = media.samples(coefs)
    order = media.zigzag()
    for c, s in zip(coefs, got, strict=True):
        block = np.zeros(64)
        block[order] = c
        assert np.abs(np.clip(np.rint(reference_idct(block.reshape(8, 8)) + 128), 0, 255).reshape(-1) - s.astype(float)).max() <= 1
    assert order[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10] and order[-1] == 63
    grey = media.to_rgb(*(np.full((2, 2), v, np.uint8) for v in (90, 128, 128)))
    assert (grey == 90).all()


def test_tensor_shape():
    raw = np.frombuffer(b"hello world " * 100, np.uint8)
    frames, where, coefs = media.decode(media.encode(raw, np.array([0, len(raw)])))
    assert media.tensor(frames[0], where[0], coefs).shape == (frames[0].height, frames[0].width, 3)
