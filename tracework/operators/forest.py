"""Random forests whose trees grow side by side in tasks and stay in the shared folder.

A feature counts by the number of its bin (at most ``BINS``, their ends are quantiles of all rows), so a row of six features takes six bytes.
Every task receives all learning rows in that form and grows some of the trees, all of their nodes level by level, by sorting
(node, bin, label) once for each drawn feature. A tree's nodes are written as one row of the model's table: neither nodes nor rows reach
the driver, which holds the ends of the bins only. Scoring deals the rows to the trees in the same way and adds up the shares.

A task holds the learning rows (a byte a feature, and nine more) and the rows that one tree drew at about 60 bytes each; more rows need larger tasks.
Draws are hashes of (seed, tree, row), so the trees don't depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Bins of a feature.
BINS = 256
#: Tasks that share the trees.
GROUPS = 24
#: Rows of a chunk, the form in which rows are dealt to the trees.
CHUNK_ROWS = 16_384
#: Rows of all trees that grow at once, if one tree has fewer.
TOGETHER = 400_000
#: A row is drawn at most so often (of a Poisson draw of mean 1: once in 10^14).
MOST_DRAWN = 15


@dataclass(frozen=True)
class Forest:
    """Trees on Poisson draws of the rows, the square root of the features (rounded up) tried at a node, split by Gini impurity until pure."""

    trees: int
    seed: int
    depth: int
    bootstrap: bool = True
    rate: float = 1.0

    def setBootstrap(self, value: bool) -> Forest:  # noqa: N802
        return replace(self, bootstrap=value)

    def setSubsamplingRate(self, value: float) -> Forest:  # noqa: N802
        """Rows drawn for a tree, as a share of all; with replacement if ``bootstrap``."""
        return replace(self, rate=value)

    def fit(self, rows: DataFrame) -> Model:
        """rows: label (0, 1, ...) and features (array of doubles, none of them missing). What else a row has tells it from others with these features."""
        spark = rows.sparkSession
        inputs, most = rows.agg(F.max(F.size("features")), F.max("label")).first()
        if not inputs:
            raise ValueError("a forest needs rows")
        at = [i / (BINS - 1) for i in range(BINS)]
        found = rows.agg(*[F.percentile_approx(F.get("features", F.lit(i)), at, 1_000_000) for i in range(inputs)]).first()
        distinct = [np.unique(np.asarray(values, float)) for values in found]
        model = Model(folder(spark, "forest"), self.trees, int(most) + 1, min(GROUPS, self.trees), [_ends(values) for values in distinct])
        keyed = rows.select(F.xxhash64(*[c for c in rows.columns if c != "features"], "features").alias("key"), F.col("label").cast("int").alias("label"), "features")
        grow = _grower(self, model)
        grown = _dealt(_chunks(keyed, model, ["key", "label"]), model.groups).mapInArrow(grow, "group int, tree int, nodes binary, gains array<double>")
        grown.write.option("compression", "zstd").parquet(model.path)
        return model


@dataclass(frozen=True)
class Model:
    """path: a table of trees (group, tree, nodes, gains: the impurity that each feature took away)."""

    path: str
    trees: int
    classes: int
    groups: int
    ends: list

    def importances(self, spark) -> np.ndarray:
        """Each feature's share of the impurity taken away, a tree's shares adding up to 1."""
        gains = F.col("gains")
        total = F.aggregate(gains, F.lit(0.0), lambda a, b: a + b)
        share = spark.read.parquet(self.path).where(total > 0).select(F.posexplode(F.transform(gains, lambda g: g / total)).alias("i", "share"))
        out = np.zeros(len(self.ends))
        for row in share.groupBy("i").agg(F.sum("share").alias("s")).collect():
            out[row.i] = row.s
        return out / out.sum() if out.sum() else out

    def _met(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Trees, then the chunks of rows, of each group of trees together."""
        trees = rows.sparkSession.read.parquet(self.path).select("group", "tree", F.col("nodes").alias("chunk"))
        return _dealt(_chunks(rows, self, columns), self.groups, trees)

    def probabilities(self, rows: DataFrame, key: str) -> DataFrame:
        """key, probs: the mean shares of all trees for every different key. rows: key and features."""
        classes = self.classes

        def run(batches):
            for carried, shares in _walked(batches, classes):
                total = shares.sum(0)
                yield pa.RecordBatch.from_arrays([carried.column(0), *[pa.array(total[:, c]) for c in range(classes)]], [key, *[f"p{c}" for c in range(classes)]])

        kind = rows.schema[key].dataType.simpleString()
        part = self._met(rows.dropDuplicates([key]), [key]).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"p{c} double" for c in range(classes)))
        return part.groupBy(key).agg(F.array(*[F.round(F.sum(f"p{c}") / self.trees, 12) for c in range(classes)]).alias("probs"))

    def votes(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """columns, pass, class, prob: every tree's share of every class for every row."""
        classes = self.classes

        def run(batches):
            for (carried, shares), first in _walked(batches, classes, numbers=True):
                t, n = shares.shape[:2]
                again = pa.array(np.tile(np.repeat(np.arange(n), classes), t))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(again) for c in carried.columns], pa.array(np.repeat(first, n * classes)), pa.array(np.tile(np.arange(classes, dtype=np.int32), n * t)), pa.array(shares.ravel())],
                    [*columns, "pass", "class", "prob"],
                )

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
        return self._met(rows, columns).mapInArrow(run, f"{kinds}, pass int, class int, prob double")


def _ends(values: np.ndarray) -> np.ndarray:
    """Between each two values the middle, or the lower of both if the middle isn't below the upper."""
    middle = values[:-1] / 2 + values[1:] / 2
    return np.where(middle < values[1:], middle, values[:-1])


def _chunks(rows: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """chunk: some rows' columns and the bins of their features, as bytes."""
    ends = model.ends

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                values = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(ends))
                bins = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(ends)], 1).astype(np.uint8)
                out = pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(ends)), part.num_rows, [None, pa.py_buffer(bins.tobytes())])], [*columns, "x"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(out)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk"])

    return rows.select(*columns, "features").mapInArrow(pack, "chunk binary")


def _unpacked(chunk: bytes, inputs: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """(columns, bins)."""
    batch = pa.ipc.open_stream(chunk).read_all().combine_chunks().to_batches()[0]
    x = batch.column(batch.num_columns - 1)
    bins = np.frombuffer(x.buffers()[1], np.uint8, len(x) * inputs, x.offset * inputs).reshape(-1, inputs)
    return batch.select(batch.schema.names[:-1]), bins


def _dealt(chunks: DataFrame, groups: int, trees: DataFrame | None = None) -> DataFrame:
    """group, tree, chunk: every chunk (tree -1) for every group, a group in one task, after the trees (if given)."""
    every = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("tree"), "chunk")
    every = every if trees is None else every.unionByName(trees)
    dealt = every.repartitionById(groups, F.col("group"))
    return dealt if trees is None else dealt.sortWithinPartitions("group", F.desc("tree"))


# --- growing


def _mixed(*parts) -> np.ndarray:
    """Uniform unsigned 64-bit hashes of whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = out ^ np.asarray(part).astype(np.uint64)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = (out ^ (out >> np.uint64(31))) + np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _drawn(kind: Forest, tree: int, key: np.ndarray) -> np.ndarray:
    """How often a tree has each row; a tree that would have none has all."""
    u = (_mixed(kind.seed, tree, key) >> np.uint64(11)) / 2.0**53
    if not kind.bootstrap:
        times = (u < kind.rate).astype(np.uint8)
    else:
        terms = np.cumprod([np.exp(-kind.rate), *(kind.rate / np.arange(1, MOST_DRAWN))])
        times = np.searchsorted(np.cumsum(terms), u, side="right").astype(np.uint8)
    return times if times.any() else np.ones(len(key), np.uint8)


def grown_trees(kind: Forest, trees: list[int], x: np.ndarray, label: np.ndarray, key: np.ndarray, classes: int) -> list[tuple]:
    """(feature, bin, shares, gains) of each tree: its nodes level by level, feature -1 for a leaf; a node's rows with a bin up to its own go left.

    shares has a row for each leaf; the children of the n-th node that has any are the nodes 2n + 1 and 2n + 2.
    """
    inputs = x.shape[1]
    tried = int(np.ceil(np.sqrt(inputs)))
    flat, label = np.ascontiguousarray(x).ravel(), label.astype(np.int64)
    row, at, times = [], [], []
    for i, tree in enumerate(trees):
        drawn = _drawn(kind, tree, key)
        own = np.flatnonzero(drawn)
        row.append(own)
        at.append(np.full(len(own), i, np.int64))
        times.append(drawn[own])
    row, at, times = np.concatenate(row), np.concatenate(at), np.concatenate(times).astype(np.int64)
    which = np.arange(len(trees))  # the tree of each node of the level
    before = np.zeros(len(trees), np.int64)  # nodes of each tree in the levels above
    gains = np.zeros((len(trees), inputs))
    low, wide = max(1, (classes - 1).bit_length()), 4  # bits of a label, of a number of times
    levels = []
    for depth in range(kind.depth + 1):
        nodes = len(which)
        counts = np.bincount(at * classes + label[row], weights=times, minlength=nodes * classes).reshape(nodes, classes)
        total = counts.sum(1)
        feature, cut = np.full(nodes, -1, np.int8 if inputs < 128 else np.int32), np.zeros(nodes, np.uint8)
        number = before[which] + np.arange(nodes) - np.searchsorted(which, which)  # in its tree
        can = (counts.max(1) < total) & (depth < kind.depth)
        if can.any():
            held = can[at]
            row, at, times = row[held], (np.cumsum(can) - 1)[at[held]], times[held]
            of = np.flatnonzero(can)
            known, size = counts[of], total[of]
            chance = _mixed(kind.seed + 1, np.asarray(trees)[which[of]][:, None], number[of][:, None], np.arange(inputs)[None])
            order = np.argsort(chance, axis=1)[:, :tried]
            base = (known**2).sum(1) / size
            best, best_feature, best_bin = base * (1 + 1e-12), np.full(len(of), -1), np.zeros(len(of), np.int64)
            key_bits = int(len(of)).bit_length() + 8 + wide + low
            small = np.uint32 if key_bits <= 32 else np.uint64
            tail = (times << low | label[row]).astype(small)
            start = at.astype(small) << small(8 + wide + low)
            for slot in range(tried):
                chosen = order[:, slot]
                packed = start | flat[row * inputs + chosen[at]].astype(small) << small(wide + low) | tail
                packed.sort()
                place = packed >> small(wide + low)
                last = np.flatnonzero(place[1:] != place[:-1])  # the last row of a bin of a node
                node = (place[last] >> small(8)).astype(np.int64)
                inside = node == (place[last + 1] >> small(8)).astype(np.int64)
                last, node = last[inside], node[inside]
                if not len(last):
                    continue
                weight = (packed >> small(low) & small((1 << wide) - 1)).astype(np.int64)
                own = (packed & small((1 << low) - 1)).astype(np.int64)
                up = np.cumsum(size) - size
                left_size = np.cumsum(weight)[last] - up[node]
                left, right = np.zeros(len(last)), np.zeros(len(last))
                for c in range(classes):
                    if c < classes - 1:
                        part = np.cumsum(weight * (own == c))[last] - (np.cumsum(known[:, c]) - known[:, c])[node]
                        rest = part if c == 0 else rest + part
                    else:
                        part = left_size - (rest if classes > 1 else 0)
                    left += part.astype(float) ** 2
                    right += (known[node, c] - part) ** 2
                score = left / left_size + right / (size[node] - left_size)
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                top = np.maximum.reduceat(score, first)
                hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(node)))))
                hit = hit[np.concatenate([[True], node[hit][1:] != node[hit][:-1]])]
                better = top > best[node[hit]]
                hit, better = hit[better], node[hit][better]
                best[better], best_feature[better], best_bin[better] = score[hit], chosen[better], (place[last[hit]] & small(255)).astype(np.int64)
            split = best_feature >= 0
            feature[of[split]], cut[of[split]] = best_feature[split], best_bin[split]
            np.add.at(gains, (which[of[split]], best_feature[split]), (best - base)[split])
            held = split[at]
            row, at, times = row[held], at[held], times[held]
            right = flat[row * inputs + best_feature[at]] > best_bin[at]
            at = 2 * (np.cumsum(split) - 1)[at] + right
            split = of[split]
        else:
            split = np.zeros(0, np.int64)
        levels.append((which, feature, cut, counts / np.maximum(total, 1)[:, None]))
        before += np.bincount(which, minlength=len(trees))
        which = np.repeat(which[split], 2)
        if not len(which):
            break
    which, feature, cut, shares = (np.concatenate(part) for part in zip(*levels, strict=True))
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(trees)))
    out = []
    for i, tree in enumerate(trees):
        mine = order[ends[i - 1] if i else 0 : ends[i]]
        out.append((tree, feature[mine], cut[mine], shares[mine][feature[mine] < 0], gains[i]))
    return out


def _grower(kind: Forest, model: Model):
    inputs, classes, trees, groups = len(model.ends), model.classes, model.trees, model.groups

    def grow(batches):
        held, group = [], None
        for batch in batches:
            for g, chunk in zip(batch.column("group").to_pylist(), batch.column("chunk"), strict=True):
                group = g
                held.append(_unpacked(chunk.as_py(), inputs))
        if group is None:
            return
        x = np.concatenate([bins for _, bins in held])
        key = np.concatenate([b.column("key").to_numpy() for b, _ in held])
        label = np.concatenate([b.column("label").to_numpy() for b, _ in held])
        held = None
        mine = list(range(group, trees, groups))
        step = max(1, TOGETHER // len(x))
        for a in range(0, len(mine), step):
            for tree, feature, cut, shares, gains in grown_trees(kind, mine[a : a + step], x, label, key, classes):
                blob = b"".join([len(feature).to_bytes(8, "little"), feature.astype(np.int32).tobytes(), cut.tobytes(), shares.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([tree], pa.int32()), pa.array([blob], pa.binary()), pa.array([gains.tolist()], pa.list_(pa.float64()))], ["group", "tree", "nodes", "gains"])

    return grow


# --- walking


def _tree(blob: bytes, classes: int) -> tuple:
    """(feature, bin, left child or the leaf itself, shares of every node; zeros for those with children)."""
    n = int.from_bytes(blob[:8], "little")
    feature, cut = np.frombuffer(blob, np.int32, n, 8), np.frombuffer(blob, np.uint8, n, 8 + 4 * n)
    leaf = feature < 0
    shares = np.zeros((n, classes))
    shares[leaf] = np.frombuffer(blob, np.float64, leaf.sum() * classes, 8 + 5 * n).reshape(-1, classes)
    return feature, cut, np.where(leaf, -1, 2 * np.cumsum(~leaf) - 1), shares


def _walked(batches, classes: int, numbers: bool = False):
    """(columns, shares by tree, row and class) of chunks of rows; with ``numbers`` also the numbers of the trees."""
    trees = []
    for batch in batches:
        for tree, chunk in zip(batch.column("tree").to_pylist(), batch.column("chunk"), strict=True):
            if tree >= 0:
                trees.append((tree, _tree(chunk.as_py(), classes)))
                continue
            whole = pa.ipc.open_stream(chunk.as_py()).read_all().combine_chunks().to_batches()[0]
            step = 1024 if numbers else whole.num_rows
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                packed = part.column(part.num_columns - 1)
                inputs = packed.type.byte_width
                x = np.frombuffer(packed.buffers()[1], np.uint8, len(packed) * inputs, packed.offset * inputs).reshape(-1, inputs)
                carried = part.select(part.schema.names[:-1])
                kept = np.stack([_leaf_shares(t, x) for _, t in trees]) if numbers else sum(_leaf_shares(t, x) for _, t in trees)[None]
                yield ((carried, kept), np.array([n for n, _ in trees], np.int32)) if numbers else (carried, kept)


def _leaf_shares(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, cut, left, shares = tree
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        now = at[open_]
        open_, now = open_[left[now] >= 0], now[left[now] >= 0]
        at[open_] = left[now] + (x[open_, feature[now]] > cut[now])
    return shares[at]
