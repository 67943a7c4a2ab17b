"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Vectors. Terms are of two kinds. The hashed words of the text are one. For the other its bytes become a sequence of symbols (a run of letters of one
case is one symbol, line feeds, digits and each kind of punctuation their own),
with a mark for words that repeat the word before and for lines that were seen
before in the text, whose n-grams (1 to 3) are hashed. Both are counted, square
rooted relative counts of each kind are weighted by inverse document frequency and projected on
the leading singular directions of the learning rows; vectors are unit length.

Learning. Rows with a label that are not held out; if there are more than
``max_train_docs``, those with the smallest hash of doc_id, whole (a documented
bound, so what is broadcast is bounded too). Only their vectors and labels are
broadcast.

Scoring. Every whole text's vector is compared with every learning vector by
exact blocked cosine products; the ``neighbours`` nearest vote with their label,
weighted by a power of the similarity. The score is the weighted share of label 1.

Defined cases: null or empty texts have the zero vector and get the learning
rows' share of label 1; without learning rows every score is 0.5; labels with
null doc_id or quality teach nothing; a doc_id with several labels takes their
maximum; repeated rows get equal scores. Where several learning rows tie at the last place
among the neighbours, those first in the learning rows' fixed order vote. Labels, lang, source and doc_id never
enter a score. Other columns stay, those named like a new one don't. A text's terms are
counted at once, which takes about 60 bytes a byte of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, held_out, hide, ranges, show, utf8

SYMBOL_TERMS, WORD_TERMS = 2048, 2048
DIM = SYMBOL_TERMS + WORD_TERMS
RANK = 48
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Symbol of each byte: 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 space, 5 line feed, then one for each other byte."""
    kind = np.zeros(256, np.uint8)
    kind[97:123] = kind[128:] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[[32, 9, 11, 12, 13]] = 4
    kind[10] = 5
    rest = np.flatnonzero(kind == 0)
    kind[rest] = 6 + np.arange(len(rest))
    return kind


_KIND = _classes()
SYMBOLS = 128
_REPEAT, _LINE = SYMBOLS - 1, SYMBOLS - 2


def _spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inside holds, cut at row borders."""
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    first = inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]]))
    last = inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; the spans are disjoint and in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    place = ranges(length).astype(np.uint64)
    at = np.repeat(start, length) + place.astype(np.int64)
    mixed = (data[at].astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * _ODD)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(mixed, np.cumsum(length) - length)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, DIM) float32: square rooted shares of the hashed symbol n-grams, then of the hashed words."""
    n = len(at) - 1
    out = np.zeros((n, DIM), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    kind = _KIND[data]
    words, word_ends = _spans(data, at, (kind != 4) & (kind != 5))
    hashes = _hashes(data, words, word_ends)
    word_row = row[words]
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[words[1:]] == row[words[:-1]])
    lines, line_ends = _spans(data, at, kind != 5)
    line_hash = _hashes(data, lines, line_ends) ^ (row[lines].astype(np.uint64) * _ODD)
    _, firsts = np.unique(line_hash, return_index=True)
    seen = np.ones(len(lines), bool)
    seen[firsts] = False
    symbol = kind.copy()
    symbol[words[again]] = _REPEAT
    symbol[lines[seen]] = _LINE
    keep = np.ones(len(data), bool)
    keep[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1]) | (symbol[1:] > 5)
    symbol, row = symbol[keep].astype(np.int64), row[keep]
    counts = np.zeros(n * DIM)
    code = np.zeros(len(symbol), np.int64)
    for size in (1, 2, 3):
        if len(symbol) < size:
            break
        code = code[: len(symbol) - size + 1] * SYMBOLS + symbol[size - 1 :]
        whole = row[: len(code)] == row[size - 1 :]
        bucket = (code[whole] * 2654435761 + size * 97) >> 7 & (SYMBOL_TERMS - 1) if size > 1 else code[whole]
        counts += np.bincount(row[: len(code)][whole] * DIM + bucket, minlength=n * DIM)
    counts += np.bincount(word_row * DIM + SYMBOL_TERMS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_TERMS, minlength=n * DIM)
    table = counts.reshape(n, DIM)
    for part in (table[:, :SYMBOL_TERMS], table[:, SYMBOL_TERMS:]):
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    return np.sqrt(table).astype(np.float32)


def _feature_rows(batches):
    for piece in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
        table = features(*utf8(piece.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in table.astype(np.float16)], pa.binary()), piece.column("quality")], ["x", "quality"])


def _unit_rows(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def leading_directions(x: np.ndarray, rank: int, rounds: int = 8, spare: int = 16) -> np.ndarray:
    """(columns, rank): leading right singular vectors of x by subspace iteration; needs little beside x."""
    width = min(rank + spare, *x.shape)
    v = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], width)))[0].astype(np.float32)
    for _ in range(rounds):
        v = np.linalg.qr((x.T @ (x @ v)).astype(np.float64))[0].astype(np.float32)
    image = (x @ v).astype(np.float64)
    _, turn = np.linalg.eigh(image.T @ image)
    return np.ascontiguousarray(v @ turn[:, ::-1][:, :rank].astype(np.float32))


class Model:
    """Projection and the learning rows' unit vectors (RANK wide) with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, neighbours: int, power: float):
        # x is weighted in place
        self.neighbours, self.power, self.y = neighbours, power, y.astype(np.float32)
        self.share = float(y.mean()) if len(y) else 0.5
        if len(x):
            df = (x > 0).sum(0)
            self.weight = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
            x *= self.weight
            self.basis = leading_directions(x, RANK)
            self.vectors = _unit_rows(x @ self.basis)

    def project(self, x: np.ndarray) -> np.ndarray:
        return _unit_rows((x * self.weight) @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), 0.5)
        z = self.project(x)
        near = z @ self.vectors.T
        k = min(self.neighbours, len(self.y))
        last = np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        inside = -near < last
        tied = -near == last
        top = np.nonzero(inside | (tied & (np.cumsum(tied, 1) <= k - inside.sum(1, keepdims=True))))[1].reshape(len(x), k)
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(1)
        voted = (weight * self.y[top]).sum(1) / np.maximum(total, 1e-300)
        return np.where((x.any(1)) & (total > 0), voted, self.share)


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = 4000, neighbours: int = 15, power: float = 8.0, seed: int = 42) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out()).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    chosen = known.orderBy("h", "doc_id").limit(max_train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), F.struct("h", "doc_id", F.xxhash64("text").alias("t")).alias("k"))
    # A doc_id may have many rows: the bound is on different (doc_id, text), counted after the join.
    keep = rows.select("k").distinct().orderBy("k").limit(max_train_docs).agg(F.max("k").alias("k"))
    rows = rows.crossJoin(F.broadcast(keep.select(F.col("k").alias("most")))).where("k <= most").dropDuplicates(["k"]).select("text", "quality")  # one row
    found = rows.mapInArrow(_feature_rows, "x binary, quality int").toPandas()
    found = found.sort_values(["quality", "x"])  # whatever order the tasks ended in
    x = np.empty((len(found), DIM), np.float32)
    for i, row in enumerate(found["x"]):
        x[i] = np.frombuffer(row, np.float16)
    return Model(x, found["quality"].to_numpy(), neighbours, power)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Columns of docs but text, then held_out, score, predicted."""
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, others = hide(docs, ["doc_id", "text"], ["held_out", "score", "predicted"])
    columns = [c for c in rows.columns if c != "text"]

    def run(batches):
        for piece in chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS):
            score = shared.value.score(features(*utf8(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], pa.array(score, pa.float64())], [*columns, "score"])

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(run, schema)
    return show(scored, ["doc_id"], others, [held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")])
