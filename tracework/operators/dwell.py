"""ON runs of a trace and what follows from them.

Frames form: one row a frame (trace_id, frame, intensity, on). Array form: one
row a trace. The frames form shuffles once, by trace; all windows and
aggregates reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(frames: DataFrame, min_width: int = 1, keys: tuple[str, ...] = ("trace_id",), extra: tuple[Column, ...] = ()) -> DataFrame:
    """keys, run (from 0), start, end (inclusive), width, peak_frame, and extra aggregates: maximal stretches of ON of min_width frames or more."""
    order = W.partitionBy(*keys).orderBy("frame")
    island = F.col("frame") - F.row_number().over(order)
    found = (
        frames.where("on").withColumn("_island", island).groupBy(*keys, "_island")
        .agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).cast("int").alias("width"),
             F.max_by("frame", F.struct("intensity", (-F.col("frame")).alias("f"))).alias("peak_frame"), *extra)
        .where(F.col("width") >= min_width).drop("_island")
    )
    return found.withColumn("run", (F.row_number().over(W.partitionBy(*keys).orderBy("start")) - 1).cast("int"))


def off_times(found: DataFrame, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Runs, then off: frames between a run and the next (NULL after the last)."""
    after = F.lead("start").over(W.partitionBy(*keys).orderBy("run"))
    return found.withColumn("off", after - F.col("end") - 1)


def peak_summary(found: DataFrame, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """keys, n_peaks, first_peak, last_peak, delta_first_second (-1 where there is no second)."""
    ordered = F.sort_array(F.collect_list("peak_frame"))
    rows = found.groupBy(*keys).agg(ordered.alias("p"))
    delta = F.when(F.size("p") > 1, F.get("p", F.lit(1)) - F.get("p", F.lit(0))).otherwise(-1)
    return rows.select(*keys, F.size("p").alias("n_peaks"), F.array_min("p").alias("first_peak"), F.array_max("p").alias("last_peak"), delta.alias("delta_first_second"))


def features(frames: DataFrame, min_width: int = 1, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """keys, n_runs, mean_on, mean_off, duty_cycle, mean_intensity.

    Duty cycle: ON frames, too narrow runs included, over the window from the first run's start to the last one's end;
    NULL without runs. mean_off is NULL with a single run.
    """
    found = off_times(runs(frames, min_width, keys, (F.avg("intensity").alias("run_intensity"),)), keys)
    each = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("width").alias("mean_on"), F.avg("off").alias("mean_off"), F.avg("run_intensity").alias("mean_intensity"),
        (F.max("end") - F.min("start") + 1).alias("window"),
    )
    on = frames.groupBy(*keys).agg(F.sum(F.col("on").cast("int")).alias("on_frames"))
    return on.join(each, list(keys), "left").select(
        *keys, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "mean_on", "mean_off", (F.col("on_frames") / F.col("window")).alias("duty_cycle"), "mean_intensity",
    )


def forest_features(frames: DataFrame, frame_ms: float, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """keys and mean, std (ddof 1, 0 of a single value) and total of ON and OFF times in ms; traces of fewer than two runs are dropped."""
    found = off_times(runs(frames, 1, keys), keys)
    on, off = F.col("width") * F.lit(float(frame_ms)), F.col("off") * F.lit(float(frame_ms))
    both = [("on", on), ("off", off)]
    aggs = [F.avg(c).alias(f"mean_{n}_ms") for n, c in both] + [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{n}_ms") for n, c in both] + [F.sum(c).alias(f"total_{n}_ms") for n, c in both]
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs).where("_n >= 2").drop("_n")


def array_runs(on: Column, min_width: int = 1) -> Column:
    """array<struct<start, end>> of a boolean array's runs: a fold that opens, extends and closes."""
    kind = "struct<open:int,found:array<struct<start:int,end:int>>,at:int>"
    zero = F.from_json(F.lit('{"open":-1,"found":[],"at":0}'), kind)
    close = lambda s: F.when(
        (s["open"] >= 0) & (s["at"] - s["open"] >= min_width), F.concat(s["found"], F.array(F.struct(s["open"].alias("start"), (s["at"] - 1).alias("end"))))
    ).otherwise(s["found"])

    def step(s, v):
        opened = F.when(v, F.when(s["open"] >= 0, s["open"]).otherwise(s["at"])).otherwise(F.lit(-1))
        return F.struct(opened.alias("open"), F.when(v, s["found"]).otherwise(close(s)).alias("found"), (s["at"] + 1).alias("at"))

    return F.aggregate(on, zero, step, close)


def highest_run_window(found: DataFrame, lengths: DataFrame, frames: int, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """keys, centre, window_start, window_end for every trace of lengths (keys, length): so many frames around the middle of the run with the largest mean, clamped into the trace; without a run around the trace's middle."""
    best = found.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct("run_intensity", (-F.col("run")).alias("r"))).alias("b"))
    rows = lengths.select(*keys, "length").join(best, list(keys), "left")
    centre = F.coalesce(F.floor((F.col("b.start") + F.col("b.end")) / 2), F.floor(F.col("length") / 2)).cast("int")
    width = F.least(F.lit(frames), F.col("length"))
    start = F.least(F.greatest(F.lit(0), centre - frames // 2), F.col("length") - width)
    return rows.select(*keys, centre.alias("centre"), start.alias("window_start"), (start + width).alias("window_end"))
