"""Two-class tests, adjusted p-values, histograms, coverage ranges and pivots."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import quantiles, running
from .sampling import numbered


#: The p-value is exact where a sample has at most so many values and no value occurs twice.
EXACT_MOST = 8
#: Beyond so many values of the larger sample its places are taken as continuous.
COUNTED_MOST = 250_000


@lru_cache(64)
def null_counts(m: int, n: int) -> tuple[np.ndarray, int]:
    """(ways in which u is at most 0, 1, ..., m n // 2, all ways) to place m values among n, as whole numbers.

    By recurrence on m: a further value adds any multiple of its rank, and what would pass n is taken off again.
    """
    ways = np.zeros(m * n // 2 + 1, object)
    ways[0] = 1
    for i in range(1, m + 1):
        for first in range(min(i, len(ways))):
            ways[first::i] = np.cumsum(ways[first::i])
        if n + i < len(ways):
            ways[n + i :] = ways[n + i :] - ways[: -(n + i)]
    return np.cumsum(ways), math.comb(m + n, m)


def exact_p(m: int, n: int, u: float) -> float:
    """Two-sided p-value of u (of either sample) for untied samples of m <= n values."""
    least = int(min(u, m * n - u))
    if n <= COUNTED_MOST:
        upto, every = null_counts(m, n)
        return min(1.0, 2 * (int(upto[least]) / every))
    x = (least + (m + 1) / 2) / (n + 1)  # sum of m uniforms
    return min(1.0, 2 * sum((-1) ** k * math.comb(m, k) * (x - k) ** m for k in range(int(x) + 1)) / math.factorial(m))


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series, n1: pd.Series, n2: pd.Series, u: pd.Series, exact: pd.Series) -> pd.Series:
    """Exact p-values where told, else P(|Z| >= z); there is one row a test."""
    normal = z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2))), na_action="ignore")
    return pd.Series([exact_p(int(min(a, b)), int(max(a, b)), v) if e else p for p, a, b, v, e in zip(normal, n1, n2, u, exact, strict=True)], dtype="float64")


def mann_whitney(rows: DataFrame, group: str, first: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """keys, n1, n2, u, r (1 - 2 u / (n1 n2)), p: two-sided; NULL for fewer than 2 in a class.

    p is exact where the smaller class has at most EXACT_MOST values and none is tied, else normal with ties and continuity.
    Values are counted first and ranked by ranges of the value; NULL and NaN are left out.
    """
    keys = keys or []
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    counts = ok.groupBy(*keys, F.col(value).alias("v")).agg(F.sum((F.col(group) == first).cast("long")).alias("a"), F.count(F.lit(1)).alias("c"))
    ranks = running(counts, keys, [*keys, "v"], {"upto": "c"}).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    c = F.col("c").cast("double")
    sums = ranks.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum("a").cast("double").alias("n1"), F.sum(F.col("c") - F.col("a")).cast("double").alias("n2"), F.sum(c * c * c - c).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    enough = (n1 >= 2) & (n2 >= 2)
    out = sums.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.when(enough, u).alias("u"), F.when(enough, 1 - 2 * u / (n1 * n2)).alias("r"), F.when(enough & (spread > 0), F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5) / spread).alias("z"), (enough & (F.col("ties") == 0) & (F.least(n1, n2) <= EXACT_MOST)).alias("exact"))
    return out.withColumn("p", _two_sided(*[F.col(c) for c in ("z", "n1", "n2", "u", "exact")])).drop("z", "exact")


def benjamini_hochberg(tests: DataFrame, p: str = "p", family: list[str] | None = None) -> DataFrame:
    """tests, then p_adjusted: p m / rank, running minimum from the largest down, at most 1. family: columns that name separate sets of tests."""
    family = family or []
    m = F.count(p).over(W.partitionBy(*family))
    rows = tests.withColumn("_rank", F.row_number().over(W.partitionBy(*family).orderBy(F.col(p).asc_nulls_last()))).withColumn("_raw", F.col(p) * m / F.col("_rank"))
    down = W.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_rank", "_raw")


def histogram(rows: DataFrame, value: str, bins: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin (from 0), n: equal bins, the last one closed; empty bins count 0."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / F.lit((high - low) / bins))).cast("int")
    counts = rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_range(rows: DataFrame, group: str, value: str, low: float = 0.1, high: float = 0.9, pad: float = 0.05) -> DataFrame:
    """One row: range_low, range_high over the classes' percentile ranges with a pad (of the largest value's size where all are equal); classes of fewer than two values are skipped."""
    each = quantiles(rows, [group], value, [low, high]).where("n >= 2")
    ends = each.agg(F.min(F.col("q")[0]).alias("a"), F.max(F.col("q")[1]).alias("b"))
    wide = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * pad).otherwise(F.abs("b") * pad + 1e-9)
    return ends.select((F.col("a") - wide).alias("range_low"), (F.col("b") + wide).alias("range_high"))


def flatten_lists(rows: DataFrame, group: str, lists: str) -> DataFrame:
    """group, traces, n, mean over the exploded lists."""
    every = rows.select(group, F.explode_outer(lists).alias("v"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("traces")).join(every.groupBy(group).agg(F.count("v").alias("n"), F.avg("v").alias("mean")), group)


def heatmap(rows: DataFrame, index: str, column: str, values: list, measure: str) -> DataFrame:
    """One row an index, mean_<v> and std_<v> (ddof 0) for each v of column; values are named, so no extra pass finds them."""
    out = rows.groupBy(index).pivot(column, values).agg(F.avg(measure).alias("mean"), F.stddev_pop(measure).alias("std"))
    return out.select(index, *[F.col(f"`{v}_mean`").alias(f"mean_{v}") for v in values], *[F.col(f"`{v}_std`").alias(f"std_{v}") for v in values])


def wide_columns(rows: DataFrame, group: str, values: list, value: str, order: list[str]) -> DataFrame:
    """row, then a column for each group with its values from the top; shorter groups end in NULL. Rows are numbered by ranges of the order."""
    return numbered(rows, group, order, "row").groupBy("row").pivot(group, values).agg(F.first(value))
