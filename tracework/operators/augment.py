"""Augmentation of training traces; never applied before a split or to validation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.seeded import normal, uniform


def _interpolate(values: Column, length: Column) -> Column:
    """The trace at ``length`` evenly spaced places over its whole span."""
    step = F.when(length > 1, (F.size(values) - 1) / (length - 1)).otherwise(0.0)

    def place(b, i):
        last = F.size(b["v"]) - 1
        at = F.least(last.cast("double"), i * b["step"])
        low = F.floor(at).cast("int")
        return F.get(b["v"], low) + (at - low) * (F.get(b["v"], F.least(low + 1, last)) - F.get(b["v"], low))

    bound = F.struct(values.alias("v"), step.alias("step"), (length - 1).cast("int").alias("last"))
    return arrays.let(bound, lambda b: F.transform(F.sequence(F.lit(0), b["last"]), lambda i: place(b, i)))


def augmented(rows: DataFrame, factor: int, id_: str = "trace_id", seed: int = 42, warp: float = 0.03, noise: float = 0.02, scale: float = 0.02) -> DataFrame:
    """factor - 1 copies of each row (values, copy from 1): a resampling round trip through a length that is normally spread around the trace's (``warp``, within 5 %),
    normal noise of ``noise`` times the spread of what that left, and a normally spread factor (``scale``, within 5 %).
    """
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor - 1)))) if factor > 1 else rows.withColumn("copy", F.lit(1)).where("false")
    key = (F.col(id_), F.col("copy"))
    v = F.col("values")
    near = lambda salt, sigma: F.greatest(F.lit(0.95), F.least(F.lit(1.05), 1 + sigma * normal(seed, salt, *key)))
    length = F.floor(F.size(v) * near("warp", warp)).cast("int")
    there = copies.withColumn("_v", F.when(length > 1, arrays.let(_interpolate(v, length), lambda w: _interpolate(w, F.size(v)))).otherwise(v))
    bound = F.struct(F.col("_v").alias("v"), (arrays.std(F.col("_v")) * noise).alias("s"), near("scale", scale).alias("f"))
    noisy = arrays.let(bound, lambda b: F.transform(b["v"], lambda x, i: (x + b["s"] * normal(seed, "noise", *key, i)) * b["f"]))
    return there.withColumn("values", noisy).drop("_v")


def mirror(values: Column, on: Column) -> Column:
    """The active window (first to last ON frame) reversed; everything where nothing is ON."""
    n = F.size(values)
    first = F.coalesce(F.nullif(F.array_position(on, True), F.lit(0)), F.lit(1)).cast("int")
    last = (n + 1 - F.coalesce(F.nullif(F.array_position(F.reverse(on), True), F.lit(0)), F.lit(1))).cast("int")
    return F.concat(F.slice(values, F.lit(1), first - 1), F.reverse(F.slice(values, first, last - first + 1)), F.slice(values, last + 1, n - last))


def training_rows(rows: DataFrame, fold: int, factor: int, seed: int = 42, mirrored: bool = False, on: Column | None = None) -> DataFrame:
    """The rows outside the fold with copy 0, their augmented copies and, if asked for, their mirrors (copy -1). Seed + fold, so folds differ."""
    train = rows.where(F.col("fold") != fold)
    out = train.withColumn("copy", F.lit(0)).unionByName(augmented(train, factor, seed=seed + fold))
    if mirrored:
        out = out.unionByName(train.withColumn("values", mirror(F.col("values"), on)).withColumn("copy", F.lit(-1)))
    return out
