"""Whitening of embeddings from exact second moments, by a bit-sliced scatter.

Entries become integers x = floor(scale * c) + offset, and each different x vector is fitted once.
Within a task the entries of a dimension, less that dimension's smallest, are cut into bit planes: plane b
packs bit b of 64 rows into a word. The AND of two planes has as many ones as rows have both bits, so a sum of
popcounts, weighted by two to the power of both places, is a sum of products, exactly; a further dimension of all
ones gives sums and the count. Only counts by (dimension, dimension, place) leave a task.

The driver puts them together in Python's whole numbers and centres there: n * sum(xy) - sum(x) * sum(y) is n squared
times a covariance without any rounding. Only then it divides, and takes eigenvectors. What reaches
the driver and the tasks is bounded by the square of the dimension, never by the rows.

Defined cases: a vector that is null or empty, or holds a null, NaN or infinite entry, is dropped, and so is one
whose length isn't the commonest (the longer of two that are as common). Entries beyond 2^53 after scaling are taken as 2^53. Equal rows, null ids and
rows of equal vectors each get their own result. Directions without spread (eigenvalue at most 1e-12 of the largest)
can't be whitened and are left out; a single different vector, and an empty table, give no components.
A deviation that doesn't fit a long is null. Other columns are kept, but for those with the name of a new one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hide, quoted, show, written

SCALE, OFFSET, MOST = 64, 1_000_000, 16
#: Rows of a block, a multiple of 64.
BLOCK = 1 << 13
FLAT = 1e-12


@dataclass(frozen=True)
class Whitener:
    """What a fit found. low and sums (of x - low) are whole numbers; columns of ``directions`` are unit eigenvectors, ``values`` their eigenvalues."""

    n: int
    low: list[int]
    high: list[int]
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum(x), exactly: in longs where they hold it, else in Python's whole numbers."""
        if self.n * max([b - a for a, b in zip(self.low, self.high, strict=True)], default=0) < 1 << 62:
            return (x - np.array(self.low, np.int64)) * self.n - np.array(self.sums, np.int64)
        return (x.astype(object) - np.array(self.low, object)) * self.n - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Row sums of squares; None beyond a long."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(1).tolist()
        exact = (centred.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ (self.directions / np.sqrt(self.values))


def integers(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """rows with x (array of long) beside the vector; unfit vectors are dropped."""
    c = F.transform(vector, lambda v: v.cast("double"))
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    limit = float(1 << 53)
    x = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), v * scale))).cast("long") + offset)
    return rows.where(F.coalesce(ok, F.lit(False))).withColumn("x", x)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, place) of the planes with a one in them, of non-negative rows; a last dimension is all ones."""
    n, d = x.shape
    padded = -(-n // 64) * 64
    kept, dimension, place = [], [], []
    for j in range(d + 1):
        column = x[:, j] if j < d else np.ones(n, np.int64)
        for b in range(int(column.max(initial=0)).bit_length()):
            bits = np.zeros(padded, np.uint8)
            bits[:n] = (column >> b) & 1
            if bits.any():
                kept.append(np.packbits(bits).view(np.uint64))
                dimension.append(j)
                place.append(b)
    return np.array(kept), np.array(dimension), np.array(place)


def scatter(blocks, low: np.ndarray) -> dict[int, np.ndarray]:
    """place -> matrix of counts: the sum over places of 2^place * counts is the sum of products of x - low, and of ones."""
    d = len(low)
    total: dict[int, np.ndarray] = {}
    for block in blocks:
        words, dimension, place = planes(block - low)
        for i in range(len(words)):
            counts = np.bitwise_count(words[i] & words[i:]).sum(1, dtype=np.int64)
            places = place[i] + place[i:]
            for s in np.unique(places).tolist():
                own = places == s
                if s not in total:
                    total[s] = np.zeros((d + 1, d + 1), np.int64)
                # Off the diagonal of planes a pair stands for both orders; only (i <= j) is kept of dimensions.
                same = (dimension[i:] == dimension[i]) & (np.arange(i, len(words)) > i)
                np.add.at(total[s], (dimension[i], dimension[i:][own]), (counts * np.where(same, 2, 1))[own])
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches, d: int):
    """x rows in blocks of BLOCK, however small the batches are."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_matrix(batch.column(0), d))
        size += batch.num_rows
        if size >= BLOCK:
            rows = np.concatenate(held)
            for a in range(0, size - size % BLOCK, BLOCK):
                yield rows[a : a + BLOCK]
            held, size = [rows[size - size % BLOCK :]], size % BLOCK
    if size:
        yield np.concatenate(held)


def fit(x_rows: DataFrame, most: int = MOST) -> Whitener:
    """x (array of long, one length) of every row -> the whitener of the different ones."""
    different = written(x_rows.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("_rows")).select("x"), "whitening-fit")
    ends = different.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.min("v"), F.max("v")).orderBy("j").collect()  # a row a dimension
    low, high, d = [r[1] for r in ends], [r[2] for r in ends], len(ends)
    if not d:
        return Whitener(0, [], [], [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    shift = np.array(low, np.int64)

    def count(batches):
        for s, counts in scatter(_blocks(batches, d), shift).items():
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), s, np.int32)), pa.array(counts[i, j])], ["i", "j", "place", "n"])

    sums = different.mapInArrow(count, "i int, j int, place int, n long").groupBy("i", "j", "place").agg(F.sum("n").alias("n"))
    products = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, place, n in sums.toLocalIterator():  # at most as many rows as dimensions squared times places
        products[i][j] += n << place
    n, total = products[d][d], [products[i][d] for i in range(d)]
    centred = [[n * products[min(i, j)][max(i, j)] - total[i] * total[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in centred])
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    order = order[values[order] > FLAT * max(values.max(), 0.0)] if trace > 0 else order[:0]
    directions = directions[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(len(order))]) if len(order) else np.zeros(0)
    found = Whitener(n, low, high, total, directions * signs, values[order], values[order] / trace if trace else values[order])
    return Whitener(**{**found.__dict__, "identity_error": _identity_error(different, found)})


def _identity_error(different: DataFrame, found: Whitener) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over the fitted vectors themselves."""
    k, d = len(found.values), len(found.low)
    if not k:
        return 0.0

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, d):
            w = found.whitened(found.centred(x))
            first += w.sum(0)
            second += w.T @ w
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["at", "v"])

    sums = dict(different.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v")).collect())  # k + k * k rows
    every = np.array([sums[i] for i in range(k + k * k)]) / found.n
    mean = every[:k]
    return float(np.abs(every[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """rows with a fit vector, then n, deviation, whitened and explained (arrays by component), identity_error."""
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    hidden, others = hide(rows, [vector], new)
    numbers = integers(hidden.withColumnRenamed(vector, "v") if vector != "v" else hidden, "v")
    lengths = numbers.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0][0] if lengths else 0
    numbers = numbers.where(F.size("x") == d)
    found = fit(numbers, most)
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(found)  # a few numbers a dimension and component

    def run(batches):
        own = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = own.centred(_matrix(batch.column("x"), d))
            w = own.whitened(centred)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(own.deviations(centred), pa.int64()), lists], [*kept, "deviation", "whitened"])

    kept = [c for c in numbers.columns if c != "x"]
    schema = T.StructType([*numbers.select(*kept).schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = numbers.mapInArrow(run, schema).withColumns({"n": F.lit(found.n).cast("long"), "explained": F.array(*[F.lit(float(v)) for v in found.explained]).cast("array<double>"), "identity_error": F.lit(found.identity_error)})
    return show(out, [F.col("v").alias(vector)], others, new)


def components(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """One row a vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    found = whiten(rows.select(quoted(id_).alias("id"), quoted(vector).alias("vector")), "vector", most)
    each = found.select("id", "n", "deviation", "identity_error", F.explode(F.arrays_zip("whitened", "explained", F.transform("whitened", lambda _, i: (i + 1).cast("int")).alias("component"))).alias("c"))
    return each.select(F.col("id").alias(id_), "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")
