"""The pipeline's stages, each against what it may and must do to its own input."""

import hashlib
import itertools
import random

import corpus_pipeline as pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracework.llm import mixing, simhash, suffix_dedup
from tracework.llm.common import read_table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def test_stages_keep_the_columns(spark, sf_dir, docs):
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_language_stage_rejects_only_the_doubtful(spark, sf_dir, docs):
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 ...", "en", "s", 9)], docs.schema)
    kept = pipeline.language(spark, docs.unionByName(odd), sf_dir)
    assert kept.where(F.col("doc_id") >= 10**6).count() == 0 and kept.count() == docs.count()


def test_near_copy_stage_leaves_one_of_each_group(spark, sf_dir, docs):
    rng = random.Random(0)
    rows = docs.where("length(text) > 2000 and doc_id % 40 = 0").limit(8).collect()
    planted = []
    for r in rows:
        planted.append((r.doc_id + 10**6, r.text, r.lang, r.source, r.n_chars))
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "zzz"
        planted.append((r.doc_id + 2 * 10**6, " ".join(words), r.lang, r.source, r.n_chars))
    every = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in pipeline.near_copies(spark, every, sf_dir).select("doc_id").collect()}
    assert not {p[0] for p in planted} & kept
    alone = docs.groupBy("text").agg(F.min("doc_id").alias("i")).count()
    assert 0.9 * alone <= len(kept) <= alone


def near_components(texts, least=0.8):
    """{i: smallest j of its component} by brute force over five-word shingles."""
    sets, root = [simhash.shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_copy_stage_is_brute_force(spark, sf_dir, docs):
    rng = random.Random(1)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (60, 120, 300, 900):
        for share in (0.004, 0.01, 0.02, 0.03, 0.05, 0.08):
            words = new(n)
            texts.append(words)
            for _ in range(4):  # similarities from about 0.4 to 1
                texts.append([w if rng.random() > share else "zzz" for w in words])
    # a chain: its first text shares nothing but the chain with its last, of which there are two
    words = new(100)
    for i in range(9):
        texts.append([*new(7 * i), *words[7 * i :]])
    texts.append(texts[-1])
    texts = [" ".join(t) for t in texts]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = [r.doc_id for r in pipeline.near_copies(spark, spark.createDataFrame(rows, docs.schema), sf_dir).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(near_components(texts).values()))


def plain_print(text):
    """(SimHash of 192 bits as an int, number of distinct five-word shingles), bit by bit."""
    full, found = (1 << 64) - 1, simhash.shingles(text)
    votes = [0] * 192
    for shingle in found:
        own = xxhash.xxh64_intdigest(shingle, 42)
        for k in range(3):
            x = own
            if k:
                x = x + k * 0x9E3779B97F4A7C15 & full
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
                x = (x ^ x >> 27) * 0x94D049BB133111EB & full
                x ^= x >> 31
            for b in range(64):
                votes[64 * k + b] += x >> b & 1
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > len(found)), len(found)


def groups_of(label):
    out = {}
    for i, g in label.items():
        out.setdefault(g, set()).add(i)
    return {frozenset(g) for g in out.values()}


@pytest.fixture(scope="module")
def edited():
    """Texts of 1 to 300 words with 0 to many edits, and pairs of few shingles."""
    rng, texts = random.Random(3), ["", "one", "ONE ", "a b c d e f", "A b  c d e f"]
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(40):  # eight words, and the same with one more at either end
        words = new(8)
        texts += [" ".join(words), " ".join([*words, *new(1)]), " ".join([*new(1), *words])]
    for n in (6, 7, 12, 30, 60, 150, 300):
        for cut in (0.005, 0.01, 0.02, 0.04, 0.1):
            words = new(n)
            texts += [" ".join(w if rng.random() > cut else "zz" for w in words) for _ in range(4)]
    return list(dict.fromkeys(texts))


def test_near_copy_candidates_are_fingerprints_within_the_radius(spark, edited):
    prints, root = [plain_print(t) for t in edited], list(range(len(edited)))
    for i, j in itertools.combinations(range(len(edited)), 2):
        (x, m), (y, n) = prints[i], prints[j]
        apart = x ^ y
        if not apart or (min(m, n) > 3 and apart.bit_count() <= 56 and (apart & (1 << 64) - 1).bit_count() <= 26):
            old, kept = root[j], root[i]
            root = [kept if r == old else r for r in root]
    table = spark.createDataFrame(list(enumerate(edited)), "node long, text string").repartition(5)
    got = {r.node: r["class"] for r in simhash.print_classes(table).collect()}
    assert groups_of(got) == groups_of(dict(enumerate(root)))


def test_near_copy_buckets_lose_no_pair(spark, edited):
    """With buckets of chosen bits, too, all texts of similarity 0.8 are in one class; classes are no wider than by all pairs."""
    table = spark.createDataFrame(list(enumerate(edited)), "node long, text string")
    whole, dealt = ({r.node: r["class"] for r in simhash.print_classes(table, most=most).collect()} for most in (1024, 8))
    near = near_components(edited)
    assert all(dealt[i] == dealt[j] for i, j in near.items())
    assert all(any(g <= w for w in groups_of(whole)) for g in groups_of(dealt))


def test_print_links_of_crowded_buckets():
    rng = np.random.default_rng(5)
    flip = lambda n, bits: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3, bits), np.uint64), axis=2)
    groups = [rng.integers(0, 1 << 64, 3, np.uint64) ^ flip(n, 8) for n in (150, 90, 1, 1, 1)]
    prints = np.concatenate(groups)[rng.permutation(243)]
    bucket = np.sort(rng.integers(0, 2, 243))
    found = dict(zip(*simhash.print_links(bucket, prints), strict=True))
    first = prints[:, 0].view(np.int64)
    for k in (0, 1):
        at = np.flatnonzero(bucket == k)
        near = (np.bitwise_count(prints[at, None] ^ prints[None, at]).sum(2) <= 56) & (np.bitwise_count(prints[at, None, 0] ^ prints[None, at, 0]) <= 26)
        for i, row in zip(at, near, strict=True):
            assert {found.get(x, x) for x in first[at[row]]} == {found.get(first[i], first[i])}
    assert len({found.get(x, x) for x in first}) <= 2 * len(groups)


@pytest.mark.parametrize("shift", [1, 63, 64, 65, 300])
def test_lanes_within(shift):
    rng = np.random.default_rng(shift)
    a = rng.integers(0, 1 << 64, 500, np.uint64)
    a[::2] = a[0]
    planes = simhash.bit_planes(a)
    for radius, share in itertools.product((0, 7, 26, 31, 32, 64), (0.01, 0.9)):
        ask = rng.random(500 - shift) < share
        got = simhash.lanes_within(planes, shift, simhash.packed(ask, planes.shape[1] - 1 - shift // 64), radius)
        assert got.tolist() == np.flatnonzero(ask & (np.bitwise_count(a[:-shift] ^ a[shift:]) <= radius)).tolist()


def test_near_copy_stage_keeps_one_row_whatever_the_ids(spark, sf_dir, docs):
    text, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(i, t, "en", "s", 1) for i, t in ((None, text), (None, text), (None, other), (7, other + " c"), (7, other + " c"), (8, "alone"), (None, "alone too"))]
    kept = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(None, text), (7, other + " c"), (8, "alone"), (None, "alone too")], key=str)


def test_passage_stage_is_the_operator(spark, sf_dir, docs):
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, sf_dir).select("doc_id", "text").collect()}
    for r in suffix_dedup.dedup(docs.select("doc_id", "text"), keep=True).collect():
        text = bytes(r.kept_bytes).decode("utf-8", "ignore")
        assert got.get(r.doc_id, "") == text


def test_mixing_stage_takes_what_the_operator_says(spark, sf_dir, docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    out = pipeline.mixed(spark, docs, sf_dir).withColumn("n", mixing.word_count())
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {i: n for i, n in taken.items() if n}


def test_mixing_stage_emits_the_selected_blocks(spark, sf_dir, docs):
    """Blocks of one word and one shard a source here; the stream and the systematic sample are done again in Python."""
    code = lambda key: hashlib.md5(key.encode()).hexdigest()
    texts = {i: " " * (i % 2) + " ".join(f"d{i}w{j}" for j in range(40 * i + 1)) for i in range(12)}
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in texts.items()]
    table = spark.createDataFrame(rows, docs.schema)
    taken = {r.doc_id: r.taken for r in mixing.mix(table).collect()}
    expected = []
    for source in range(3):
        stream = [(i, w) for i in sorted(range(source, 12, 3), key=lambda i: code(f"42:{i}")) for w in texts[i].split()]
        n, quota = len(stream), sum(taken[i] for i in range(source, 12, 3))
        assert n < mixing.SHARD_BLOCKS
        c = [(k * quota + int(code("42:phase:0")[:8], 16) % n) // n for k in range(n + 1)]
        for i in range(source, 12, 3):
            times = [(w, c[k + 1] - c[k]) for k, (j, w) in enumerate(stream) if j == i]
            expected += [(i, [w for w, m in times if m >= copy]) for copy in range(1, 1 + max(m for _, m in times))]
    got = [(r.doc_id, r.text.split()) for r in pipeline.mixed(spark, table, sf_dir).collect()]
    assert sorted(got) == sorted(expected)
    assert any(taken[i] < len(texts[i].split()) for i in taken)


def test_run_packs_everything_that_stays(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir)
    bins = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert bins.where("n <> end or n > 2048").count() == 0
    total, n = rows.agg(F.sum("length")).first()[0], bins.count()
    assert n <= total / 2048 * 1.01 + 2
