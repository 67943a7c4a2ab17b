"""Byte-level BPE: texts to token ids and back, by overlapping chunks.

Encoding. A text of more than ``chunk`` characters is cut into chunks that overlap by ``overlap``
characters; chunks are dealt over all tasks and pre-tokenised on their own. The pattern never looks
back, so from any place where two runs both end a match they agree for good: chunk k and chunk k + 1
are stitched at the first boundary that both have in their overlap. Chunk 0 begins at the text's
start, so every stitched boundary is a true one. Then the matches between the stitches
are encoded, each on its own, and a text's ids are joined in the order of its chunks. A text with an overlap that
holds no common boundary (one match fills it: a long run of spaces or letters) is cut again into
chunks and overlaps sixteen times as long, until it has none; a text within one chunk needs no stitch.

Matches that end within ``GUARD`` characters of a chunk's end aren't believed, as more text could
change them (the pattern's longest look ahead is two characters, after an apostrophe).

Decoding looks every id's bytes up and joins them: no text is decoded, so any ids are fine.

Defined cases: a null or empty text has no ids; a null list of ids gives no bytes; malformed UTF-8 is
read as U+FFFD, as a tokenizer's caller would have to; repeated rows and null doc_ids are encoded like any
others; an empty table gives an empty result. ``encode`` leaves out all columns but doc_id and text, whatever their names.
Long texts: a task holds one chunk's ids at a time; a text's whole list of ids meets in one row, as the result has it.
An id outside the vocabulary is an error in ``decode``.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, chunks, hide, ranges, show, written

CHUNK, OVERLAP, GUARD, GROWTH = 1 << 14, 1 << 10, 4, 16
BATCH_BYTES, BATCH_IDS = 1 << 20, 1 << 18
#: A task remembers the ids of so many different matches; longer ones than CACHED are encoded each time.
REMEMBERED, CACHED = 1 << 17, 64


@lru_cache(2)
def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Matches(dict):
    """Match -> its ids, found when first asked for."""

    def __init__(self, vocabulary: str):
        super().__init__()
        # A pattern that takes its input whole: one match is one piece to merge.
        self.whole = tiktoken.Encoding("match", pat_str=r"(?s).+", mergeable_ranks=_ranks(vocabulary), special_tokens={})

    def __missing__(self, match: str) -> list[int]:
        ids = self.whole.encode_ordinary(match)
        if len(match) <= CACHED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids


@lru_cache(2)
def _matches(vocabulary: str) -> _Matches:
    return _Matches(vocabulary)


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def ids_of(matches: list[str], vocabulary: str) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(_matches(vocabulary).__getitem__, matches)), np.int32)


def boundaries(text: str, last: bool) -> np.ndarray:
    """0 and the ends of the matches from the text's start; those near its end only if nothing follows it."""
    ends = np.cumsum([0, *map(len, _pattern().findall(text))])
    return ends if last else ends[ends <= len(text) - GUARD]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _encode_short(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Texts within a chunk: one chunk is the whole text."""

    def run(batches):
        for part in chunks(batches, "text", BATCH_BYTES):
            found = [ids_of(_pattern().findall(_text(x)), vocabulary) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(found)], ["doc_id", "ids"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, key, k, last, part (bytes), copies: one row a chunk of each different (doc_id, text), dealt over all tasks."""

    def run(batches):
        for rows in chunks(batches, "text", BATCH_BYTES):
            keys, ks, lasts, parts, at = [], [], [], [], []
            for i, (key, value) in enumerate(zip(rows.column("key").to_pylist(), rows.column("text").to_pylist(), strict=True)):
                text = _text(value)
                for k, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    keys.append(key)
                    ks.append(k)
                    lasts.append(start + chunk + overlap >= len(text))
                    parts.append(text[start : start + chunk + overlap].encode())
                    at.append(i)
            ids = rows.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(ks, pa.int32()), pa.array(lasts, pa.bool_()), pa.array(parts, pa.binary())], ["doc_id", "key", "k", "last", "part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kind}, key string, k int, last boolean, part binary")
    return cut.groupBy("key", "k").agg(F.first("doc_id").alias("doc_id"), F.first("last").alias("last"), F.first("part").alias("part"), F.count(F.lit(1)).alias("copies"))


def _stitches(cut: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, k, from, to (places in the chunk; to is null at the text's end), failed (the text has an overlap without a common boundary)."""

    def run(batches):
        for rows in batches:
            head, tail = [], []
            for k, last, part in zip(rows.column("k").to_pylist(), rows.column("last").to_pylist(), rows.column("part").to_pylist(), strict=True):
                ends = boundaries(part.decode(), last)
                head.append(ends[ends < overlap] if k else ends[:0])
                tail.append(ends[:0] if last else ends[ends >= chunk] - chunk)
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("k"), rows.column("last"), _lists(head), _lists(tail)], ["key", "k", "last", "head", "tail"])

    ends = cut.select("key", "k", "last", "part").mapInArrow(run, "key string, k int, last boolean, head array<int>, tail array<int>")
    order = W.partitionBy("key").orderBy("k")
    met = ends.withColumn("at", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    found = met.select("key", "k", "last", F.when(F.col("k") == 0, 0).otherwise(F.col("at")).alias("from"), (F.lead("at").over(order) + chunk).alias("to"))
    return found.withColumn("failed", F.max(F.col("from").isNull()).over(W.partitionBy("key")))


def _encode_pieces(cut: DataFrame, stitches: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids: the matches between the stitches, joined in order."""
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            found = []
            for part, start, stop in zip(rows.column("part").to_pylist(), rows.column("from").to_pylist(), rows.column("to").to_pylist(), strict=True):
                text, own = part.decode(), []
                for match in _pattern().finditer(text, start):
                    if stop is not None and match.start() >= stop:
                        break
                    own.append(match.group())
                found.append(ids_of(own, vocabulary))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_id", "key", "k", "copies")] + [_lists(found)], ["doc_id", "key", "k", "copies", "ids"])

    pieces = cut.join(stitches.where("not failed").select("key", "k", "from", "to"), ["key", "k"]).select("doc_id", "key", "k", "copies", "part", "from", "to")
    encoded = pieces.mapInArrow(run, f"doc_id {kind}, key string, k int, copies long, ids array<int>")
    whole = encoded.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", F.flatten(F.col("p.ids")).alias("ids"))


def encode(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array of int) by the ranks in a .tiktoken file; one row a row of docs."""
    if not GUARD < overlap <= chunk:
        raise ValueError("the overlap must be longer than the guard and no longer than a chunk")
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    size = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))
    out = _encode_short(docs.where(size <= chunk), vocabulary)
    # A key that doesn't depend on partitions: recomputed tasks give the same one.
    long_ = docs.where(size > chunk).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.when(F.col("doc_id").isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01")), "text"), 256))
    while True:
        cut = _cut(long_, chunk, overlap)
        stitches = written(_stitches(cut, chunk, overlap), "bpe-stitches")
        if not stitches.take(1):
            return out
        out = out.unionByName(_encode_pieces(cut, stitches, vocabulary))
        again = stitches.where("failed and k = 0").select("key")
        if not again.take(1):
            return out
        long_ = long_.join(again, "key", "left_semi")
        chunk, overlap = chunk * GROWTH, overlap * GROWTH


def _by_ids(batches, ids: str):
    """Batches cut to about BATCH_IDS ids (one long row may exceed it)."""
    for batch in batches:
        ends = np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BATCH_IDS, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """rows, then decoded (binary): the bytes of the ids, joined. A column of that name is replaced."""

    def run(batches):
        tokens = {rank: token for token, rank in _ranks(vocabulary).items()}
        table = [tokens.get(i) for i in range(max(tokens) + 1)]
        sizes = np.array([-1 if t is None else len(t) for t in table], np.int64)
        first = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        data = np.frombuffer(b"".join(t for t in table if t is not None), np.uint8)
        for batch in _by_ids(batches, ids):
            column = batch.column(ids)
            lists = column.fill_null([]) if column.null_count else column
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(table) or (sizes[flat] < 0).any()):
                raise ValueError("an id is not in the vocabulary")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            size = sizes[flat]
            every = data[np.repeat(first[flat], size) + ranges(size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(every, ends)], [*batch.schema.names, "decoded"])

    hidden, others = hide(rows.withColumn(ids, F.col(ids).cast("array<int>")), [ids], ["decoded"])
    found = hidden.mapInArrow(run, T.StructType([*hidden.schema.fields, T.StructField("decoded", T.BinaryType())]))
    return show(found, [], others, [ids, "decoded"])
