"""Fixed length, validity and normalisation of traces (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def fix_length(values: Column, length: int) -> Column:
    """Cut to length, or pad with NaN."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(float("nan")), missing))


def is_valid(values: Column) -> Column:
    """No frame is NULL, NaN or exactly 0."""
    return ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v == 0))


def drop_invalid(traces: DataFrame, column: str = "values") -> DataFrame:
    return traces.where(is_valid(F.col(column)))


def fixed(traces: DataFrame, length: int, column: str = "values") -> DataFrame:
    """Traces of one length; those that needed padding, or hold a 0, are dropped."""
    return drop_invalid(traces.withColumn(column, fix_length(F.col(column), length)), column)


def trim_tail(values: Column, n: int) -> Column:
    """Without the last n frames; an error where nothing would be left."""
    kept = F.slice(values, F.lit(1), F.size(values) - n)
    return F.when(F.size(values) > n, kept).otherwise(F.raise_error(F.lit(f"a trace is not longer than the {n} frames to trim")))


def remove_background(values: Column, level: Column) -> Column:
    return arrays.let(level, lambda base: F.transform(values, lambda v: v - base))


def zscore(values: Column) -> Column:
    """Population z-score; a constant trace becomes zeros."""
    spread = arrays.let(arrays.std(values), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    both = F.struct(arrays.mean(values).alias("centre"), spread.alias("spread"))
    return arrays.let(both, lambda b: F.transform(values, lambda v: (v - b["centre"]) / b["spread"]))


def minmax(values: Column) -> Column:
    """To [0, 1]; a constant trace becomes zeros."""
    span = arrays.let(F.array_max(values) - F.array_min(values), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    both = F.struct(F.array_min(values).alias("low"), span.alias("span"))
    return arrays.let(both, lambda b: F.transform(values, lambda v: (v - b["low"]) / b["span"]))


def sanitize(values: Column) -> Column:
    """NaN to 0, infinities to +-1e6."""
    far = F.lit(1e6)
    return F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), far).when(v == float("-inf"), -far).otherwise(v))


def normalizations(traces: DataFrame, level: Column) -> DataFrame:
    """One row a trace and normalisation: raw, bg_rm, zscored, minmax. Each follows from raw row by row, so there is no shuffle."""
    raw = F.col("values")
    kinds = {"raw": raw, "bg_rm": remove_background(raw, level), "zscored": zscore(raw), "minmax": minmax(raw)}
    rows = F.array(*[F.struct(F.lit(k).alias("norm"), v.alias("values")) for k, v in kinds.items()])
    return traces.withColumn("_n", F.explode(rows)).select(*[c for c in traces.columns if c != "values"], "_n.norm", "_n.values")


def dataset(traces: DataFrame, channels: list[str], trim_end: int = 0) -> DataFrame:
    """Long traces (trace_id, class_idx, norm, values) -> trace_id, class_idx, channels (array of arrays), trimmed to the shortest.

    A trace must have every channel. The shortest length is one number, joined as a broadcast row.
    """
    rows = traces.where(F.col("norm").isin(channels))
    shortest = rows.agg(F.min(F.size("values")).alias("shortest"))
    wide = rows.groupBy("trace_id", "class_idx").agg(F.map_from_entries(F.collect_list(F.struct("norm", "values"))).alias("m"))
    wide = wide.where(F.size("m") == len(channels)).crossJoin(F.broadcast(shortest))
    cut = [F.slice(F.element_at("m", c), F.lit(1), F.col("shortest") - trim_end) for c in channels]
    return wide.select("trace_id", "class_idx", F.array(*cut).alias("channels"))


def to_ms(frames: Column, frame_ms: float) -> Column:
    """Frame counts in milliseconds; NULL and NaN stay."""
    return frames * F.lit(float(frame_ms))


def common_traces(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose trace is also in right."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")
