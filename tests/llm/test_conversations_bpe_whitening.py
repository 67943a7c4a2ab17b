"""Conversation repair, byte-level BPE and whitening against plain versions."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracework.llm import byte_bpe, conversations, queries, whitening
from tracework.llm.conversations import Trails, best_edits, chained, replay

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONV = "conv_id long, turn long, role string, text string"


def cheapest(initials, faults):
    """Every edit string by plain search: breadth over (rows done, letters), the least (cost, string) kept per output."""
    want = re.compile("(s?(ua)+)?")
    best = None
    n = len(initials)
    for keep in itertools.product("KRD", repeat=n):
        if any(f in (1, 2) and k != "D" for f, k in zip(faults, keep)):
            continue
        for holes in itertools.product(range(3), repeat=n + 1):
            cost = 3 * sum(holes) + sum({"K": 0, "R": 3, "D": 4}[k] + (3 if k != "D" and f == 3 else 0) for k, f in zip(keep, faults))
            audit = "".join("I" * holes[i] + (keep[i] if i < n else "") for i in range(n + 1))
            if best is not None and (cost, audit) >= best:
                continue
            options = [[""]]
            for i in range(n + 1):
                options += [["u", "a"]] * holes[i]
                if i < n:
                    options.append({"K": [initials[i]], "R": ["u", "a"], "D": [""]}[keep[i]])
            if any(want.fullmatch("".join(o)) for o in itertools.product(*options)):
                best = cost, audit
    return best


def test_edits_equal_a_plain_search():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(0, 3)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        found = best_edits(initials, faults, 0, True)
        assert min((c, e) for s, (c, e) in found.items() if s in (0, 3)) == cheapest(initials, faults)


def test_blocks_chained_give_the_same_edits():
    r = random.Random(6)
    for _ in range(40):
        n = r.randint(2, 30)
        initials, faults = [r.choice("suaax") for _ in range(n)], [r.choice([0, 0, 1, 3]) for _ in range(n)]
        whole = min((c, e) for s, (c, e) in best_edits(initials, faults, 0, True).items() if s in (0, 3))
        cuts = [0, *sorted(r.sample(range(1, n), min(3, n - 1))), n]
        blocks = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            entries = [0] if k == 0 else range(4)
            blocks.append([{"entry": e, "end": s, "cost": c, "edits": x} for e in entries for s, (c, x) in best_edits(initials[a:b], faults[a:b], e, k == 0).items()])
        cost, edits, chosen = chained(blocks)
        assert (cost, edits) == whole and "".join(e for _, e in chosen) == edits


def test_trails_compare_like_strings_even_when_hashes_collide(monkeypatch):
    r = random.Random(7)
    for modulus in ((1 << 61) - 1, 3):
        monkeypatch.setattr(conversations, "_MODULUS", modulus)
        trails, words = Trails(), {0: ""}
        for _ in range(300):
            node, letter = r.choice(list(words)), r.choice("DIKR")
            words[trails.add(node, letter)] = words[node] + letter
        for a, b in ((r.choice(list(words)), r.choice(list(words))) for _ in range(2000)):
            assert trails.less(a, b) == (words[a] < words[b])
            assert trails.letters(a) == words[a]


def plain_audit(rows):
    """The contract, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        left = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        left += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, left in convs.items():
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in left:
            last = re.search("[^ \t-\r](?=[ \t-\r]*\\Z)", text)
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last.group() not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in left if t is not None}
        initials = [x[1][:1] for x in left]
        cost, audit = min((c, e) for s, (c, e) in best_edits(initials, faults, 0, True).items() if s in (0, 3))
        text = "\n".join(replay([x[1:] for x in left], audit, 0))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_rows():
    r = random.Random(8)
    rows = [(1, None, None, None), (1, None, "user", ""), (None, 1, "user", "Hi."), (None, None, "assistant", "x" * 100_000 + "."), (2, 1, "", "a."), (2, 1, "system", "a."), (2, 1, "system", "a."), (3, 5, "user", "Ünï 　"), (3, 9, "assistant", " \t\n")]
    return rows + [(r.randint(10, 40), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", None]), r.choice(["Yes.", "No", "", None, "Why? ", "A.\n", "B"])) for _ in range(400)]


@pytest.mark.parametrize("block", [3, 4096])
def test_conversations_equal_the_plain_version(spark, block):
    rows = odd_rows()
    found = {r[0]: tuple(r)[1:] for r in conversations.audit(spark.createDataFrame(rows, CONV).repartition(5), block).collect()}
    assert found == plain_audit(rows)


def test_conversations_empty_extra_columns_and_lost_ones(spark):
    assert conversations.audit(spark.createDataFrame([], CONV)).collect() == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(lost, 0, "user", "Hi.", 1, 2)], CONV + ", cost int, `a.b` int")
    row = conversations.audit(rows).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_of_equal_rows(spark):
    rows = spark.range(30_000).selectExpr("7L AS conv_id", "1L AS turn", "'user' AS role", "'Hm.' AS text")
    row = conversations.repair(rows, 1000).collect()
    assert len(row) == 1 and row[0].duplicate == 29_999 and row[0].cost == 4 * 29_999 + 3 and row[0].audit == "K" + "D" * 29_999 + "I"


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("sizes", [(32, 8), (200, 200), (1 << 14, 1 << 10)])
def test_bpe_equals_the_library_on_odd_texts(spark, own, sizes):
    r = random.Random(1)
    texts = [None, "", "a", " ", "don't we'll 're", " " * 500 + "b", "a" + " " * 3000 + "b", "x" * 5000, "it's a   test\n\n  of 12 things... 　 é" * 300, "".join(r.choice("ab '\n\tré1.,ll") for _ in range(9000)), "<|endoftext|> x"]
    rows = [*enumerate(texts), (None, texts[8]), (8, texts[8])]
    found = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, "doc_id int, text string"), VOCABULARY, *sizes), VOCABULARY).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(x.doc_id, list(x.ids), bytes(x.decoded)) for x in found], key=key) == sorted([(i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows], key=key)


@pytest.mark.parametrize("filler", [" ", "\n", "\t", "　", "a", "-", "7"])
def test_bpe_of_very_long_runs(spark, filler):
    """The library itself fails on a million spaces; the pattern's first branch that fits leaves the last one to what follows."""
    n = 1_100_000
    text = "a" + filler * n + " b"
    row = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id int, text string"), VOCABULARY), VOCABULARY).collect()
    assert len(row) == 1 and bytes(row[0].decoded).decode() == text


def test_bpe_empty_extra_columns_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert byte_bpe.decode(byte_bpe.encode(empty, VOCABULARY), VOCABULARY).collect() == []
    odd = spark.createDataFrame([(1, "hi", 3, 4)], "doc_id int, text string, ids int, `a.b` int")
    assert byte_bpe.encode(odd, VOCABULARY).columns == ["doc_id", "ids"]
    lists = spark.createDataFrame([(1, None, 5), (2, [], 6), (3, [0, 1], 7)], "doc_id int, ids array<long>, `a.b` int")
    assert [bytes(r.decoded) for r in byte_bpe.decode(lists, VOCABULARY).orderBy("doc_id").collect()] == [b"", b"", b'!"']
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id int, ids array<int>"), VOCABULARY).collect()


def test_bpe_query_over_the_whole_table(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = own.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.01").collect()} == want


def test_scatter_equals_products():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 300, (500, 5)), r.integers(0, 1 << 40, (70, 5))])
    found = whitening.scatter([x[:64], x[64:]], np.zeros(5, np.int64))
    one = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1).astype(object)
    total = sum((m.astype(object) << s for s, m in found.items()), np.zeros((6, 6), object))
    assert (np.triu(total) == np.triu(one.T @ one)).all()


def test_whitening_equals_numpy_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(np.array([r.embedding for r in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = ((n * x - s) / n) @ (vectors[:, :16] / np.sqrt(values[:16]))
    found = queries.op13_whitening(spark, "/root/testdata/sf0.01").toPandas()
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-9
    assert np.abs(found.groupby("component")["explained"].first() - values[:16] / values.sum()).max() < 1e-12
    each = found[found.component == 1].set_index("vec_id").loc[[r.vec_id for r in rows]]
    assert (each.deviation == ((n * x - s) ** 2).sum(1)).all() and (found.n == n).all() and found.identity_error.max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    kind = "vec_id int, embedding array<double>"
    assert whitening.components(spark.createDataFrame([], kind)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, None), (2, []), (3, [1.0, None]), (4, [1.0, 2.0]), (5, [1.0, 2.0])], kind)).collect() == []
    found = whitening.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [2.5, 3.0]), (1, [1.0, 2.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])], kind)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    assert all(r.n == 3 and r.identity_error < 1e-9 for r in found)
    huge = whitening.components(spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 3.0]), (3, [0.0, 7.0])], kind)).collect()
    assert [(r.vec_id, r.component, r.deviation is None) for r in huge] == [(1, 1, True), (2, 1, True), (3, 1, False)]
    clash = whitening.whiten(spark.createDataFrame([(1, [1.0], 5, 6), (2, [2.0], 7, 8)], "vec_id int, embedding array<double>, N int, `a.b` int"))
    assert clash.columns == ["embedding", "vec_id", "a.b", "n", "deviation", "whitened", "explained", "identity_error"] and clash.count() == 2
    assert clash.select(F.size("whitened")).distinct().collect()[0][0] == 1
