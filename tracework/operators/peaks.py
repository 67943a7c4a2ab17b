"""Local peaks by height and width, over whole Arrow batches of traces.

The traces of a batch stand in one array with walls (infinite values) between them. Least and largest values of all stretches of 1, 2, 4, ...
frames give, for all peaks at once, how far a peak's stretch reaches until something higher, its lowest points on both sides and where
the flanks cross half of its prominence: a number of steps that grows with the logarithm of a trace's length, none of them a Python loop over peaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that are looked at together; bounds the tables' memory.
TOGETHER = 200_000


def _stretches(x: np.ndarray, most: int, best: np.ufunc) -> list[np.ndarray]:
    """Level k at i: the best of x[i : i + 2^k]."""
    levels = [x]
    while 2 ** len(levels) <= most:
        half = 2 ** (len(levels) - 1)
        levels.append(best(levels[-1][:-half], levels[-1][half:]))
    return levels


def _walk(levels: list[np.ndarray], start: np.ndarray, passes, direction: int) -> np.ndarray:
    """From each start the nearest place in the direction that stops the walk; passes(values) tells which stretches don't."""
    at = start.copy()
    for k in reversed(range(len(levels))):
        size = 2**k
        first = at - size + 1 if direction < 0 else at
        ok = (first >= 0) & (first < len(levels[k]))
        ok[ok] = passes(levels[k][first[ok]], ok)
        at[ok] += direction * size
    return at


def _lowest(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first))
    for level in np.unique(k).tolist():
        own = k == level
        out[own] = np.minimum(levels[level][first[own]], levels[level][last[own] - 2**level + 1])
    return out


def counts(traces: list[np.ndarray], heights: np.ndarray, width: float) -> np.ndarray:
    """Peaks of each trace that reach its height and are at least so wide at half their prominence.

    A peak is the middle frame of a flat top that is higher than both neighbours.
    """
    sizes = np.array([len(t) for t in traces])
    x = np.full(sizes.sum() + len(traces) + 1, np.inf)
    starts = np.cumsum(sizes + 1) - sizes
    for a, t in zip(starts, traces, strict=True):
        x[a : a + len(t)] = t
    owner = np.repeat(np.arange(len(traces) + 1), np.append(sizes + 1, 1))  # each trace with the wall before it
    change = np.flatnonzero(x[1:] != x[:-1])
    first, last = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[first]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    top &= np.isfinite(level)
    peak = (first[top] + last[top]) // 2
    peak = peak[x[peak] >= heights[owner[peak]]]
    if not len(peak):
        return np.zeros(len(traces), np.int32)
    most = int(sizes.max()) + 1
    high, low = _stretches(x, most, np.maximum), _stretches(np.where(np.isinf(x), -np.inf, x), most, np.minimum)
    v = x[peak]
    left = _walk(high, peak, lambda s, own: s <= v[own], -1) + 1
    right = _walk(high, peak, lambda s, own: s <= v[own], 1) - 1
    half = v - (v - np.maximum(_lowest(low, left, peak), _lowest(low, peak, right))) / 2
    i = _walk(low, peak, lambda s, own: s > half[own], -1)
    j = _walk(low, peak, lambda s, own: s > half[own], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.where(x[i] < half, i + (half - x[i]) / (x[i + 1] - x[i]), i)
        b = np.where(x[j] < half, j - (half - x[j]) / (x[j - 1] - x[j]), j)
    wide = b - a >= width
    return np.bincount(owner[peak[wide]], minlength=len(traces) + 1)[: len(traces)].astype(np.int32)


def spread_height(x: np.ndarray) -> float:
    """Half of the trace's spread (ddof 1)."""
    return 0.5 * x.std(ddof=1) if len(x) > 1 else np.nan


def tail_height(x: np.ndarray) -> float:
    """Three times the spread (ddof 1) of the last 50 frames."""
    return 3 * x[-50:].std(ddof=1) if len(x) > 1 else np.nan


def peak_count(values: Column, width: float = 2.0, height: str = "spread") -> Column:
    """Number of peaks; height ``spread`` or ``tail``. NULL for a NULL trace; a trace with NULL, NaN or infinite values, or of one frame, has none."""
    rule = {"spread": spread_height, "tail": tail_height}[height]

    @F.pandas_udf("int")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = [i for i, v in enumerate(batch) if v is not None]
            out = pd.Series([None] * len(batch), dtype="Int32")
            held, size = [], 0
            for i in [*known, None]:
                if held and (i is None or size >= TOGETHER):
                    traces = [np.asarray(batch.iloc[k], np.float64) for k in held]
                    traces = [t if np.isfinite(t).all() else t[:0] for t in traces]
                    out.iloc[held] = counts(traces, np.array([rule(t) for t in traces]), width)
                    held, size = [], 0
                if i is not None:
                    held.append(i)
                    size += len(batch.iloc[i])
            yield out

    return udf(values)
