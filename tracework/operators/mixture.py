"""Two-component one-dimensional Gaussian mixtures, one for each trace.

The fit runs in an Arrow batch of traces in numpy; Spark spreads the batches.
What follows from the parameters (levels, posteriors, frame classes) are
Catalyst expressions. Start: the best split of the sorted values into two
groups (least squared error, from prefix sums); then EM until the mean log
likelihood gains less than ``tol``. A trace with fewer than two different
values, or with NaN, gets NULL parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays

NAMES = ("mean0", "mean1", "var0", "var1", "weight0")
FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])
FLOOR = 1e-6
TOGETHER = 100_000


def best_splits(x: np.ndarray) -> np.ndarray:
    """Size of the lower group in the best two-means split of every row of sorted x."""
    n = x.shape[1]
    first = np.cumsum(x, 1)
    total, first = first[:, -1:], first[:, :-1]
    k = np.arange(1, n)
    error = (x * x).sum(1, keepdims=True) - first**2 / k - (total - first) ** 2 / (n - k)
    error[x[:, 1:] == x[:, :-1]] = np.inf  # equal values stay together
    return error.argmin(1) + 1


def fit_rows(values: np.ndarray, most: int = 100, tol: float = 1e-3) -> np.ndarray:
    """(mean0, mean1, var0, var1, weight0) of every row of values, mean0 the smaller; NaN where no mixture can be fitted.

    All rows take their steps together; a row that has settled takes no more.
    """
    out = np.full((len(values), 5), np.nan)
    x = np.sort(np.asarray(values, np.float64), 1)
    n = x.shape[1]
    if n < 2:
        return out
    todo = np.flatnonzero(np.isfinite(x).all(1) & (x[:, 0] < x[:, -1]))
    x = x[todo]
    if not len(x):
        return out
    k = best_splits(x)[:, None]
    low = np.arange(n) < k
    count = np.concatenate([k, n - k], 1)
    mean = np.stack([np.where(low, x, 0).sum(1), np.where(low, 0, x).sum(1)], 1) / count
    off = x - np.where(low, mean[:, :1], mean[:, 1:])
    var = np.stack([np.where(low, off * off, 0).sum(1), np.where(low, 0, off * off).sum(1)], 1) / count + FLOOR
    weight = count / n
    last = np.full(len(x), -np.inf)
    for turn in range(most):
        far = x[:, :, None] - mean[:, None]
        log = (np.log(weight) - 0.5 * np.log(2 * np.pi * var))[:, None] - far * far / (2 * var[:, None])
        top = log.max(2, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(2, keepdims=True)
        gain = (top + np.log(total)).mean((1, 2))
        p /= total
        m = p.sum(1) + 1e-12
        weight, mean = m / n, (p * x[:, :, None]).sum(1) / m
        far = x[:, :, None] - mean[:, None]
        var = (p * far * far).sum(1) / m + FLOOR
        stop = np.abs(gain - last) < tol
        if turn == most - 1:
            stop[:] = True
        if stop.any():
            small = mean[stop].argmin(1)[:, None]
            pick = lambda v, at: np.take_along_axis(v[stop], at, 1)  # noqa: B023, E731
            out[todo[stop]] = np.concatenate([pick(mean, small), pick(mean, 1 - small), pick(var, small), pick(var, 1 - small), pick(weight, small)], 1)
            go = ~stop
            todo, x, mean, var, weight, gain = todo[go], x[go], mean[go], var[go], weight[go], gain[go]
            if not len(todo):
                break
        last = gain
    return out


def fit(values: np.ndarray, most: int = 100, tol: float = 1e-3) -> tuple[float, ...] | None:
    """The fit of one trace; None where there is none."""
    found = fit_rows(np.asarray(values, np.float64)[None], most, tol)[0]
    return None if np.isnan(found[0]) else tuple(found.tolist())


@F.pandas_udf(FIT)
def mixture(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Traces of one length are fitted together, so many at a time that their values fill TOGETHER."""
    for batch in values:
        out = np.full((len(batch), 5), np.nan)
        sizes = np.array([-1 if v is None else len(v) for v in batch])
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == size)
            step = max(1, TOGETHER // size)
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                out[part] = fit_rows(np.stack([np.asarray(batch.iloc[i], np.float64) for i in part]))
        yield pd.DataFrame(out, columns=list(NAMES)).astype(object).where(~np.isnan(out), None).astype("Float64")


def with_mixture(traces: DataFrame, column: str = "values", name: str = "mixture") -> DataFrame:
    return traces.withColumn(name, mixture(F.col(column)))


def background_level(params: Column, values: Column, tail: int = 500) -> Column:
    """The noise mean; without a fit, the mean of the last frames."""
    return F.coalesce(params["mean0"], arrays.mean(arrays.tail(values, tail)))


def separation(params: Column) -> Column:
    """(signal mean - noise mean) / noise spread; 0 without a fit."""
    return F.coalesce((params["mean1"] - params["mean0"]) / F.sqrt(F.greatest(params["var0"], F.lit(1e-12))), F.lit(0.0))


def posterior(v: Column, params: Column) -> Column:
    """Probability that a frame is signal."""
    log = lambda w, m, s: F.log(w) - 0.5 * F.log(s) - (v - m) * (v - m) / (2 * s)
    noise = log(params["weight0"], params["mean0"], params["var0"])
    signal = log(1 - params["weight0"], params["mean1"], params["var1"])
    return 1 / (1 + F.exp(noise - signal))


def on_mask(values: Column, params: Column, threshold: float = 0.9, min_separation: float = 3.0) -> Column:
    """array<boolean>: signal frames; all noise below the least separation or without a fit."""
    fits = params["mean0"].isNotNull() & (separation(params) >= min_separation)
    return F.transform(values, lambda v: F.coalesce(fits & (posterior(v, params) >= threshold), F.lit(False)))


def classes(values: Column, params: Column, threshold: float = 0.9, min_separation: float = 3.0) -> Column:
    """array<string>: noise, overlap or signal."""
    fits = F.coalesce(params["mean0"].isNotNull() & (separation(params) >= min_separation), F.lit(False))
    p = lambda v: posterior(v, params)
    return F.transform(values, lambda v: F.when(~fits | (p(v) < 1 - threshold), "noise").when(p(v) >= threshold, "signal").otherwise("overlap"))


def em_steps(frames: DataFrame, steps: int, key: str = "trace_id") -> DataFrame:
    """Relational EM: key, mean0, mean1, var0, var1, weight0 after a fixed number of steps.

    Start: values up to the mean of the smallest and the largest are component 0. Each step is one aggregate by key.
    """
    rows = frames.select(key, F.col("intensity").alias("v"))
    edge = (F.min("v").over(W.partitionBy(key)) + F.max("v").over(W.partitionBy(key))) / 2
    p = rows.withColumn("p0", (F.col("v") <= edge).cast("double"))
    for step in range(steps + 1):
        n0, n1 = F.sum("p0") + 1e-12, F.sum(1 - F.col("p0")) + 1e-12
        m0, m1 = F.sum(F.col("p0") * F.col("v")) / n0, F.sum((1 - F.col("p0")) * F.col("v")) / n1
        s0, s1 = F.sum(F.col("p0") * F.col("v") * F.col("v")) / n0, F.sum((1 - F.col("p0")) * F.col("v") * F.col("v")) / n1
        params = p.groupBy(key).agg(m0.alias("mean0"), m1.alias("mean1"), (s0 - m0 * m0 + FLOOR).alias("var0"), (s1 - m1 * m1 + FLOOR).alias("var1"), (n0 / F.count("v")).alias("weight0"))
        if step == steps:
            return params
        p = rows.join(params, key).withColumn("p0", 1 - posterior(F.col("v"), F.struct("mean0", "mean1", "var0", "var1", "weight0"))).select(key, "v", "p0")
