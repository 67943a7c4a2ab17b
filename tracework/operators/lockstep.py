"""Fits of many models of one kind over one table at once.

All fits of a comparison (its folds and augmentation factors) take their steps together: each step is one job over the table, in which a task adds up
every fit's gradient over its own rows, and Spark adds the tasks' sums. What reaches the driver is one row for each fit and sum,
whatever the number of rows. A fit's rows are told by its membership, a function of the row's columns, so no row is copied for a fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Ridge on standardised weights, as a share of the number of rows; keeps separable fits finite.
RIDGE = 1e-4


@dataclass(frozen=True)
class Task:
    """What a task sees: x (rows, inputs), label, and for every fit the numbers of its rows."""

    x: np.ndarray
    label: np.ndarray
    members: dict


def _sums(table: DataFrame, keys: list, member: Callable, size: int, partial: Callable) -> dict:
    """key -> vector of the sums over its rows of what ``partial(task, key)`` gives."""

    def run(batches):
        total = {k: np.zeros(size) for k in keys}
        for batch in _unpacked(batches):
            if batch.num_rows:
                x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "x"}
                task = Task(x, columns["label"], {k: np.flatnonzero(member(k, columns)) for k in keys})
                for k in keys:
                    total[k] += partial(task, k)
        for i, k in enumerate(keys):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total[k])], ["k", "i", "v"])

    out = {k: np.zeros(size) for k in keys}
    for row in table.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[keys[row.k]][row.i] = row.v
    return out


def packed(table: DataFrame) -> DataFrame:
    """chunk: the rows of each batch as bytes, written once, so that a step neither decodes nor converts rows one by one."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk"])

    return cut(table.mapInArrow(run, "chunk binary"))


def _unpacked(batches):
    """The batches, or those inside of chunks."""
    for batch in batches:
        if batch.schema.names == ["chunk"]:
            for chunk in batch.column(0):
                yield from pa.ipc.open_stream(chunk.as_buffer())
        else:
            yield batch


def scales(table: DataFrame, keys: list, member: Callable, inputs: int) -> dict:
    """key -> (number of rows, means, spreads) of its inputs; a constant input has spread 1."""
    first = _sums(table, keys, member, 1 + inputs, lambda t, k: np.concatenate([[len(t.members[k])], t.x[t.members[k]].sum(0)]))
    mean = {k: v[1:] / max(v[0], 1) for k, v in first.items()}
    second = _sums(table, keys, member, inputs, lambda t, k: ((t.x[t.members[k]] - mean[k]) ** 2).sum(0))
    spread = {k: np.sqrt(second[k] / max(first[k][0], 1)) for k in keys}
    return {k: (first[k][0], mean[k], np.where(spread[k] > 0, spread[k], 1.0)) for k in keys}


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Logistic:
    """Multinomial logistic regression by Newton steps; the first class has no weights of its own."""

    name = "logistic"

    def __init__(self, inputs: int, classes: int, seed: int = 42):
        self.inputs, self.classes, self.size = inputs, classes, (inputs + 1) * (classes - 1)

    def start(self) -> np.ndarray:
        return np.zeros(self.size)

    def probabilities(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        own = np.concatenate([z, np.ones((len(z), 1))], 1) @ w.reshape(self.inputs + 1, -1)
        return _softmax(np.concatenate([np.zeros((len(z), 1)), own], 1))

    @property
    def sums(self) -> int:
        return self.size + self.size**2

    def partial(self, w: np.ndarray, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the loss."""
        one = np.concatenate([z, np.ones((len(z), 1))], 1)
        p = self.probabilities(w, z)[:, 1:]
        gradient = one.T @ (p - (label[:, None] == np.arange(1, self.classes)))
        curvature = np.einsum("ni,nj,nab->iajb", one, one, p[:, :, None] * (np.eye(p.shape[1]) - p[:, None, :]))
        return np.concatenate([gradient.ravel(), curvature.reshape(-1)])

    def step(self, w: np.ndarray, sums: np.ndarray, rows: float, memory: dict) -> tuple[np.ndarray, bool]:
        ridge = RIDGE * rows * np.repeat([1.0] * self.inputs + [1e-6], self.classes - 1)
        gradient, curvature = sums[: self.size] + ridge * w, sums[self.size :].reshape(self.size, self.size) + np.diag(ridge)
        move = np.linalg.solve(curvature + 1e-12 * np.eye(self.size), gradient)
        return w - move, bool(np.abs(move).max() < 1e-9)


class Perceptron:
    """One hidden layer of sigmoids under a softmax, by resilient steps: a weight's step grows while its gradient keeps its sign and shrinks when it turns."""

    name = "perceptron"

    def __init__(self, inputs: int, classes: int, seed: int = 42, hidden: int = 8):
        self.inputs, self.classes, self.hidden, self.seed = inputs, classes, hidden, seed
        self.size = (inputs + 1) * hidden + (hidden + 1) * classes
        self.sums = self.size

    def start(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(0, 0.5, self.size)

    def _layers(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = (self.inputs + 1) * self.hidden
        return w[:cut].reshape(self.inputs + 1, -1), w[cut:].reshape(self.hidden + 1, -1)

    def _forward(self, w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._layers(w)
        h = 1 / (1 + np.exp(-np.clip(z @ a[:-1] + a[-1], -40, 40)))
        return h, _softmax(h @ b[:-1] + b[-1])

    def probabilities(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self._forward(w, z)[1]

    def partial(self, w: np.ndarray, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        h, p = self._forward(w, z)
        out = p - (label[:, None] == np.arange(self.classes))
        back = (out @ self._layers(w)[1][:-1].T) * h * (1 - h)
        return np.concatenate([(z.T @ back).ravel(), back.sum(0), (h.T @ out).ravel(), out.sum(0)])

    def step(self, w: np.ndarray, sums: np.ndarray, rows: float, memory: dict) -> tuple[np.ndarray, bool]:
        gradient = sums / max(rows, 1) + RIDGE * w
        was, size = memory.get("gradient", np.zeros(self.size)), memory.get("size", np.full(self.size, 0.1))
        same = gradient * was
        size = np.clip(np.where(same > 0, size * 1.2, np.where(same < 0, size * 0.5, size)), 1e-6, 2.0)
        gradient = np.where(same < 0, 0.0, gradient)
        memory |= {"gradient": gradient, "size": size}
        return w - np.sign(gradient) * size, bool(np.abs(sums / max(rows, 1) + RIDGE * w).max() < 1e-5)


def fit(table: DataFrame, keys: list, member: Callable, model, scaled: dict, most_steps: int = 100) -> dict:
    """key -> weights. table: label and x (array of doubles), and what member(key, columns) reads, which gives a mask of the key's rows.

    Steps end when every fit's gradient or move is small, at the latest after most_steps.
    """
    table = packed(table)
    weights, memory, todo = {k: model.start() for k in keys}, {k: {} for k in keys}, list(keys)
    for _ in range(most_steps):
        now = {k: weights[k] for k in todo}

        def partial(task, k, now=now):
            rows = task.members[k]
            return model.partial(now[k], (task.x[rows] - scaled[k][1]) / scaled[k][2], task.label[rows])

        found = _sums(table, todo, member, model.sums, partial)
        ready = []
        for k in todo:
            weights[k], done = model.step(weights[k], found[k], scaled[k][0], memory[k])
            ready += [k] if done else []
        todo = [k for k in todo if k not in ready]
        if not todo:
            break
    return weights


def scored(rows: DataFrame, keys: list, member: Callable, model, scaled: dict, weights: dict, columns: list[str]) -> DataFrame:
    """columns of rows, key (number in keys) and probs for every row and each key whose member() holds for it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "x"}
            for i, k in enumerate(keys):
                own = np.flatnonzero(member(k, held))
                if len(own):
                    p = model.probabilities(weights[k], (x[own] - scaled[k][1]) / scaled[k][2])
                    part = batch.take(pa.array(own))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(np.full(len(own), i, np.int32)), lists], [*columns, "key", "probs"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, key int, probs array<double>")
