"""Best-fit packing of token sequences by best-two-fit.

Tokens. Each whole text is tokenized by a given tokenizers file (special tokens that
stand in the text are found, none is added) and closed by one end id. A longer sequence than ``most`` is
cut into pieces of ``most``; its first piece takes the remainder.

Plan. Bins only depend on lengths, so the plan is made on the histogram of
lengths, which has at most ``most`` rows whatever the corpus holds. A bin is
filled greedily with the longest lengths that fit; then its smallest item is
taken out and the two unpacked lengths whose sum fits the widened gap most
tightly replace it, if they fit more tightly than the item did. The pattern
found is used as often as the histogram allows, so each pattern exhausts a
length: there are at most about ``most`` patterns, however many bins.

Assignment. Documents of one length are ranked, and ranks are matched with the
patterns' rank ranges. Ranks come from (length, shard) groups, the shard being
a hash of the piece, plus the counts of the shards before; there is a shard for
``SHARD_ROWS`` pieces, so that a length which a third of all rows share is never ranked in one task.

Defined cases: a null or empty text is the end id alone; null doc_ids and
repeated rows are packed like any others; pieces that tie in length take their places in the order of
doc_id, piece and checksum; an empty table gives an empty result. Columns beside doc_id and text are
left out. A text is tokenized whole, which takes about 12 bytes a byte.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written

MOST = 2048
END_ID = 0
LEAST_SHARDS, SHARD_ROWS = 256, 1 << 16
CHUNK_BYTES = 1 << 20
LONG_BLANK = 10_000


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for: printable bytes themselves, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def encoder(path: str):
    """texts -> id lists of a tokenizers .json file, added tokens that occur in a text included.

    A plain byte-level BPE whose ids follow its merges has the same ids in
    tiktoken, which needs a fifth of the time; any other file is run by tokenizers itself, and so is a
    text with LONG_BLANK white-space characters in a row, over which tiktoken's pattern runs out of stack.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and not spec["post_processor"] and not model.get("dropout") and not model.get("byte_fallback")
    plain = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    if plain:
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {x: i for x, i in model["vocab"].items() if x not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = [vocabulary.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and len(vocabulary) == 256 + len(merges)
    if not plain:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    byte = _byte_of_symbol()
    ranks = {bytes(byte[c] for c in x): i for x, i in vocabulary.items()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    blank = re.compile(r"\s{%d}" % LONG_BLANK)
    slow: list = []

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for x in texts:
            if len(x) >= LONG_BLANK and blank.search(x):
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(path))
                out.append(slow[0].encode(x, add_special_tokens=False).ids)
            else:
                out.append(own.encode(x, allowed_special="all"))
        return out

    return encode


def pieces(docs: DataFrame, tokenizer: str, most: int = MOST, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): one row a piece."""
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    names = [n for n, _ in fields]

    def run(batches):
        encode = encoder(tokenizer)
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            rows = ([], [], [], [], [], [])
            texts = [x or "" for x in chunk.column("text").to_pylist()]
            for i, ids in enumerate(encode(texts)):
                array = np.array([*ids, END_ID], "<u4")
                start, length = 0, (len(array) - 1) % most + 1
                piece = 0
                while start < len(array):
                    own = array[start : start + length]
                    crc = zlib.crc32(own)
                    for out, value in zip(rows, (i, piece, start, length, crc, own.astype(np.int32) if keep_ids else None), strict=True):
                        out.append(value)
                    start, length, piece = start + length, most, piece + 1
            columns = [chunk.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())]
            if keep_ids:
                columns.append(pa.array(rows[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def two_that_fit(lengths: np.ndarray, counts: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """The unpacked pair with the largest sum in (over, room]; of equal sums, that with the longest item."""
    have = lengths[counts > 0]
    low = have[::-1]  # ascending
    best = None
    at = np.searchsorted(low, room - have, "right") - 1
    for big, j in zip(have.tolist(), at.tolist()):
        while j >= 0:
            small = int(low[j])
            if small != big or counts[np.searchsorted(-lengths, -big)] > 1:
                if small <= big and over < big + small and (best is None or big + small > sum(best)):
                    best = (big, small)
                break
            j -= 1
        if best is not None and sum(best) == room:
            break
    return best


def plan(lengths: np.ndarray, counts: np.ndarray, most: int = MOST) -> list[tuple[int, list[int]]]:
    """[(times, item lengths of the bin)] that uses up the histogram."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64).copy()
    place = {int(x): i for i, x in enumerate(lengths)}
    out = []
    while (counts > 0).any():
        free = counts.copy()
        room, items = most, []
        i = 0
        while True:
            fits = np.flatnonzero((free[i:] > 0) & (lengths[i:] <= room))
            if not len(fits):
                break
            i += int(fits[0])
            n = min(int(free[i]), room // int(lengths[i])) if not items else 1
            items += [int(lengths[i])] * n
            free[i] -= n
            room -= n * int(lengths[i])
        if room and len(items) > 1:
            smallest = items[-1]
            if pair := two_that_fit(lengths, free, room + smallest, smallest):
                items = [*items[:-1], *pair]
                room += smallest - sum(pair)
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        times = min(int(counts[place[x]]) // n for x, n in need.items())
        for x, n in need.items():
            counts[place[x]] -= n * times
        out.append((times, items))
    return out


def assignment(bins: list[tuple[int, list[int]]]) -> list[tuple]:
    """(length, first rank, end rank, items a bin, first bin, offset of the first such item in a bin)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, items in bins:
        offset = 0
        for x in dict.fromkeys(items):
            n = items.count(x)
            start = used.get(x, 0)
            used[x] = start + n * times
            rows.append((x, start, used[x], n, first, offset))
            offset += n * x
        first += times
    return rows


def pack_lengths(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows (a written table) with length (1 to most, never null) -> also sequence_id, offset. The histogram reaches the driver, no row does."""
    spark = rows.sparkSession
    given = rows.columns
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in given]
    shards = max(LEAST_SHARDS, rows.count() // SHARD_ROWS)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    groups = written(rows.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    found = groups.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``most`` rows
    bins = plan(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), most)
    table = spark.createDataFrame(assignment(bins), "a_length long, a_from long, a_to long, a_each long, a_bin long, a_offset long")
    before = groups.select(F.col("length").alias("g_length"), F.col("shard").alias("g_shard"), (F.sum("n").over(W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).alias("g_before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("length", "shard").orderBy(*keys)) - 1)
    # Both sides are dealt by (length, shard) already.
    ranked = ranked.join(before, (F.col("length") == F.col("g_length")) & (F.col("shard") == F.col("g_shard")))
    ranked = ranked.withColumn("_r", F.col("_r") + F.coalesce("g_before", F.lit(0))).drop("g_length", "g_shard", "g_before")
    # The plan has at most about ``most`` patterns, so its table is bounded too.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("a_length")) & (F.col("_r") >= F.col("a_from")) & (F.col("_r") < F.col("a_to")))
    nth = F.col("_r") - F.col("a_from")
    return placed.select(*given, (F.col("a_bin") + F.floor(nth / F.col("a_each"))).alias("sequence_id"), (F.col("a_offset") + nth % F.col("a_each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, most: int = MOST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    return pack_lengths(written(pieces(docs, tokenizer, most), "packing-pieces"), most)
