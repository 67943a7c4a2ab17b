"""Quality gates and diagnostics of traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import dwell, mixture


@dataclass(frozen=True)
class Gates:
    """Limits; 0 switches a gate off where noted."""

    snr_min: float = 2.0  # 0: off
    max_duty: float = 0.5  # 0: off
    min_peaks: int = 3  # more than this many
    first_before: int = 1000
    gap_below: int = 1000
    last_after: int = 3000
    min_width: int = 1  # of a run


def frame_statistics(traces: DataFrame) -> DataFrame:
    """trace_id, mean, std (ddof 1), max, min, median, mad."""
    v = F.col("values")
    return traces.select("trace_id", arrays.mean(v).alias("mean"), arrays.std(v, 1).alias("std"), F.array_max(v).alias("max"), F.array_min(v).alias("min"), arrays.median(v).alias("median"), median_deviation(v).alias("mad"))


def median_deviation(values: Column) -> Column:
    return arrays.let(arrays.median(values), lambda mid: arrays.median(F.transform(values, lambda x: F.abs(x - mid))))


def robust_score(values: Column) -> Column:
    """(largest - median) / MAD, the MAD being 1e-10 at least."""
    return (F.array_max(values) - arrays.median(values)) / F.greatest(median_deviation(values), F.lit(1e-10))


def robust_filter(traces: DataFrame, limit: float) -> DataFrame:
    """Traces whose score is at most limit; 0 keeps all."""
    return traces if limit == 0 else traces.where(robust_score(F.col("values")) <= limit)


def keep_list(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """One keep-list for every normalisation."""
    return rows.join(kept.select(*keys).distinct(), keys, "left_semi")


def duty_cycle(on: Column) -> Column:
    """Share of ON frames in a boolean array."""
    return F.size(F.filter(on, lambda x: x)) / F.size(on)


def snr_gate(separation: Column, gates: Gates) -> Column:
    return F.lit(True) if gates.snr_min == 0 else separation >= gates.snr_min


def duty_gate(duty: Column, gates: Gates) -> Column:
    return F.lit(True) if gates.max_duty == 0 else duty <= gates.max_duty


def peak_gate(gates: Gates) -> Column:
    """Over n_peaks, first_peak, last_peak, delta_first_second."""
    return (
        (F.col("n_peaks") > gates.min_peaks) & (F.col("n_peaks") >= 2) & (F.col("first_peak") < gates.first_before)
        & (F.col("delta_first_second") < gates.gap_below) & (F.col("last_peak") > gates.last_after)
    )


def failures(gates: Gates) -> Column:
    """Reasons, as strings, why a trace's peaks fail (duty cycle and separation aren't among them); empty: they pass."""
    n, text = F.coalesce("n_peaks", F.lit(0)), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    first, gap, last = F.col("first_peak"), F.col("delta_first_second"), F.col("last_peak")
    tests = [
        (n <= gates.min_peaks, text("n_peaks=", n, f" <= {gates.min_peaks}")), (n == 0, F.lit("n_peaks=0")),
        ((n > 0) & (first >= gates.first_before), text("first_peak=", first, f" >= {gates.first_before}")),
        (n < 2, text("n_peaks=", n, " < 2 (cannot check delta)")), ((n > 1) & (gap >= gates.gap_below), text("delta_1-2=", gap, f" >= {gates.gap_below}")),
        ((n > 0) & (last <= gates.last_after), text("last_peak=", last, f" <= {gates.last_after}")),
    ]
    return F.array_compact(F.array(*[F.when(test, reason) for test, reason in tests]))


def diagnose(traces: DataFrame, gates: Gates, threshold: float = 0.9, min_separation: float = 3.0, experiments: DataFrame | None = None) -> DataFrame:
    """trace_id, separation, duty, peaks, mean to min, passed, reasons, experiment (Unknown where missing).

    A trace below the least separation has no peaks, and runs narrower than the least width have none; first_peak and last_peak are -1 without peaks.
    A mixture moves with its values, so its separation is that of the trace without background.
    """
    fitted = mixture.with_mixture(traces)
    v, m = F.col("values"), F.col("mixture")
    rows = fitted.withColumn("separation", mixture.separation(m)).withColumn("on", mixture.on_mask(v, m, threshold, min_separation))
    peak = lambda r: F.array_position(F.slice(v, r["start"] + 1, r["end"] - r["start"] + 1), F.array_max(F.slice(v, r["start"] + 1, r["end"] - r["start"] + 1))).cast("int") - 1 + r["start"]
    found = F.transform(dwell.array_runs(F.col("on"), gates.min_width), peak)
    rows = rows.withColumn("p", F.when(snr_gate(F.col("separation"), gates), found).otherwise(F.array().cast("array<int>")))
    rows = rows.select(
        "trace_id", "separation", duty_cycle(F.col("on")).alias("duty"), F.size("p").alias("n_peaks"), F.coalesce(F.get("p", F.lit(0)), F.lit(-1)).alias("first_peak"), F.coalesce(F.array_max("p"), F.lit(-1)).alias("last_peak"),
        F.when(F.size("p") > 1, F.get("p", F.lit(1)) - F.get("p", F.lit(0))).otherwise(-1).alias("delta_first_second"), arrays.mean(v).alias("mean"), arrays.std(v, 1).alias("std"), F.array_max(v).alias("max"), F.array_min(v).alias("min"),
    )
    rows = rows.withColumn("reasons", failures(gates)).withColumn("passed", F.size("reasons") == 0)
    if experiments is None:
        return rows.withColumn("experiment", F.lit("Unknown"))
    return rows.join(experiments.select("trace_id", "experiment"), "trace_id", "left").withColumn("experiment", F.coalesce("experiment", F.lit("Unknown")))


def passed_share(rows: DataFrame, passed: Column, keys: list[str]) -> DataFrame:
    """keys, before, after, percent."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"), F.sum(F.coalesce(passed, F.lit(False)).cast("long")).alias("after"))
    return found.withColumn("percent", 100.0 * F.col("after") / F.col("before"))


def tail_statistics(traces: DataFrame, mean_frames: int = 500, std_frames: int = 50) -> DataFrame:
    """trace_id, tail_mean, tail_std (ddof 1), snr = std / tail std (ddof 1; 0 for a flat tail)."""
    v = F.col("values")
    tail_std = arrays.std(arrays.tail(v, std_frames), 1)
    return traces.select("trace_id", arrays.mean(arrays.tail(v, mean_frames)).alias("tail_mean"), tail_std.alias("tail_std"), F.when(tail_std > 0, arrays.std(v, 1) / tail_std).otherwise(0.0).alias("snr"))
