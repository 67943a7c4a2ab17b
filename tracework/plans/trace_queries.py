"""Queries over traces: validity, normalisation, runs, dwell features, mixtures and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import dwell, gates, mixture, normalize, peaks
from ..sources import fixtures as X
from ..sources.fixtures import with_sql
from .registry import query, rounded

ON_LEVEL = 25.0
FRAME_MS = 10.0

_MINMAX = "n AS (SELECT *, (intensity - min(intensity) OVER w) / CASE WHEN max(intensity) OVER w = min(intensity) OVER w THEN 1 ELSE max(intensity) OVER w - min(intensity) OVER w END AS v FROM tframes WINDOW w AS (PARTITION BY trace_id))"
_RUNS = (
    "i AS (SELECT *, frame - row_number() OVER (PARTITION BY trace_id ORDER BY frame) AS island FROM f WHERE is_on), "
    "r0 AS (SELECT trace_id, min(frame) AS s, max(frame) AS e, count(*) AS width, first(frame ORDER BY intensity DESC, frame) AS peak, avg(intensity) AS m FROM i GROUP BY trace_id, island HAVING count(*) >= {width}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s) - 1 AS run, lead(s) OVER (PARTITION BY trace_id ORDER BY s) - e - 1 AS off FROM r0)"
)
_FRAME_RUNS = "f AS (SELECT *, intensity > 25 AS is_on FROM frames), " + _RUNS.format(width=1)


def _mixture_sql(frames: str, then: str) -> str:
    """The whole mixture fit in SQL: best split of the sorted values, then EM by a recursive CTE until the mean log likelihood settles; mx has a row a trace."""
    ctes = f"""fr AS MATERIALIZED (SELECT trace_id, frame, intensity AS x FROM {frames}),
 so AS (SELECT trace_id, x, row_number() OVER o AS k, sum(x) OVER o AS s, count(*) OVER g AS n, sum(x) OVER g AS total, sum(x * x) OVER g AS squares, lead(x) OVER (PARTITION BY trace_id ORDER BY x, frame) AS nx FROM fr WINDOW o AS (PARTITION BY trace_id ORDER BY x, frame ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY trace_id)),
 sp AS (SELECT trace_id, first(k ORDER BY squares - s * s / k - (total - s) * (total - s) / (n - k), k) AS best FROM so WHERE nx > x GROUP BY 1),
 st AS (SELECT trace_id, avg(x) FILTER (WHERE k <= best) AS a0, avg(x) FILTER (WHERE k > best) AS a1, var_pop(x) FILTER (WHERE k <= best) + 1e-6 AS b0, var_pop(x) FILTER (WHERE k > best) + 1e-6 AS b1, max(best) / max(n) AS w0, 1 - max(best) / max(n) AS w1 FROM so JOIN sp USING (trace_id) GROUP BY 1),
 em AS (SELECT trace_id, 0 AS step, a0, a1, b0, b1, w0, w1, -1e300::DOUBLE AS last, false AS done FROM st
  UNION ALL
  SELECT trace_id, step + 1, m0, m1, (q0 - 2 * m0 * c0 + m0 * m0 * r0) / n0 + 1e-6, (q1 - 2 * m1 * c1 + m1 * m1 * r1) / n1 + 1e-6, n0 / n, n1 / n, gain, abs(gain - last) < 1e-3
  FROM (SELECT *, c0 / n0 AS m0, c1 / n1 AS m1 FROM (
   SELECT trace_id, any_value(step) AS step, any_value(last) AS last, count(*) AS n, avg(greatest(l0, l1) + ln(1 + exp(-abs(l0 - l1)))) AS gain, sum(p) AS r0, sum(1 - p) AS r1, sum(p) + 1e-12 AS n0, sum(1 - p) + 1e-12 AS n1, sum(p * x) AS c0, sum((1 - p) * x) AS c1, sum(p * x * x) AS q0, sum((1 - p) * x * x) AS q1
   FROM (SELECT *, 1 / (1 + exp(least(700, l1 - l0))) AS p FROM (
    SELECT e.trace_id, step, last, x, ln(w0) - 0.5 * ln(2 * pi() * b0) - (x - a0) * (x - a0) / (2 * b0) AS l0, ln(w1) - 0.5 * ln(2 * pi() * b1) - (x - a1) * (x - a1) / (2 * b1) AS l1
    FROM em e JOIN fr ON fr.trace_id = e.trace_id WHERE NOT done AND step < 100)) GROUP BY trace_id))),
 fit AS (SELECT * FROM em WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY step DESC) = 1),
 mx AS (SELECT trace_id, least(a0, a1) AS mean0, greatest(a0, a1) AS mean1, CASE WHEN a0 <= a1 THEN b0 ELSE b1 END AS var0, CASE WHEN a0 <= a1 THEN b1 ELSE b0 END AS var1, CASE WHEN a0 <= a1 THEN w0 ELSE w1 END AS weight0, abs(a1 - a0) / sqrt(greatest(CASE WHEN a0 <= a1 THEN b0 ELSE b1 END, 1e-12)) AS separation FROM fit),
 po AS (SELECT trace_id, frame, x, separation, 1 / (1 + exp(least(700, (ln(weight0) - 0.5 * ln(var0) - (x - mean0) * (x - mean0) / (2 * var0)) - (ln(1 - weight0) - 0.5 * ln(var1) - (x - mean1) * (x - mean1) / (2 * var1))))) AS p FROM fr JOIN mx USING (trace_id))"""
    return with_sql(frames, then=ctes + then).replace("WITH ", "WITH RECURSIVE ", 1)


def on_frames(spark, sf_dir):
    return X.frames(spark, sf_dir).withColumn("on", F.col("intensity") > ON_LEVEL)


def minmax_frames(spark, sf_dir):
    rows = X.traces(spark, sf_dir).withColumn("v", normalize.minmax(F.col("values")))
    return rows.select("trace_id", "class_idx", F.posexplode("v").alias("frame", "intensity")).withColumn("on", F.col("intensity") > 0.5)


@query(with_sql("tframes", then=_MINMAX + ", f AS (SELECT trace_id, class_idx, frame, v AS intensity, v > 0.5 AS is_on FROM n), " + _RUNS.format(width=1) + """,
 g AS (SELECT trace_id, count(*) AS n_runs, avg(width) AS mean_on, avg(off) AS mean_off, avg(m) AS mean_intensity, max(e) - min(s) + 1 AS win FROM r GROUP BY 1),
 o AS (SELECT trace_id, class_idx, count(*) FILTER (WHERE is_on) AS n_on FROM f GROUP BY 1, 2)
 SELECT class_idx, count(*) AS traces, round(avg(mean_on), 6) AS mean_on, round(avg(mean_off), 6) AS mean_off, round(avg(n_on * 1.0 / win), 6) AS duty_cycle, round(avg(mean_intensity), 6) AS mean_intensity
 FROM o LEFT JOIN g USING (trace_id) GROUP BY 1"""))
def dwell_features(spark, sf_dir):
    found = dwell.features(minmax_frames(spark, sf_dir), 1, ("trace_id", "class_idx"))
    return rounded(found.groupBy("class_idx").agg(F.count(F.lit(1)).alias("traces"), *[F.avg(c).alias(c) for c in ("mean_on", "mean_off", "duty_cycle", "mean_intensity")]))


@query(with_sql("frames", then="SELECT trace_id, CAST(count(*) AS BIGINT) AS frames, CAST(greatest(600 - count(*), 0) AS BIGINT) AS padded FROM frames GROUP BY 1"))
def b1_fix_length(spark, sf_dir):
    v = normalize.fix_length(F.col("values"), 600)
    return X.long_traces(spark, sf_dir).select("trace_id", F.size("values").cast("long").alias("frames"), F.size(F.filter(v, lambda x: F.isnan(x))).cast("long").alias("padded"))


@query(with_sql("frames", then="SELECT trace_id, class_idx, CAST(count(*) AS BIGINT) AS frames FROM frames GROUP BY 1, 2 HAVING count(*) >= 580 AND count(*) FILTER (WHERE frame < 580 AND (intensity = 0 OR intensity IS NULL)) = 0"))
def b2_drop_invalid(spark, sf_dir):
    rows = X.long_traces(spark, sf_dir).withColumn("frames", F.size("values").cast("long"))
    return normalize.fixed(rows, 580).select("trace_id", "class_idx", "frames")


@query(with_sql("tframes", then="SELECT trace_id, round(sum(CASE WHEN frame < 60 THEN intensity END), 6) AS total FROM tframes GROUP BY 1"))
def b14_trim_tail(spark, sf_dir):
    return rounded(X.traces(spark, sf_dir).select("trace_id", arrays.total(normalize.trim_tail(F.col("values"), 4)).alias("total")))


@query(with_sql("tframes", then="SELECT trace_id, round(sum(CASE WHEN intensity > 0.2 THEN 1e6 WHEN intensity < -0.2 THEN -1e6 ELSE intensity END), 3) AS total FROM tframes GROUP BY 1"))
def b12_sanitize(spark, sf_dir):
    bad = F.transform("values", lambda v: F.when(v > 0.2, float("inf")).when(v < -0.2, float("-inf")).otherwise(v))
    return rounded(X.traces(spark, sf_dir).withColumn("bad", bad).select("trace_id", arrays.total(normalize.sanitize(F.col("bad"))).alias("total")), 3)


@query(with_sql("frames", then="m AS (SELECT trace_id, avg(intensity) AS level FROM frames WHERE frame >= 50 GROUP BY 1) SELECT trace_id, frame, round(intensity - level, 6) + 0.0 AS value FROM frames JOIN m USING (trace_id)"))
def h4_remove_background(spark, sf_dir):
    level = arrays.mean(F.slice("values", F.lit(51), F.size("values")))
    rows = X.long_traces(spark, sf_dir).withColumn("v", normalize.remove_background(F.col("values"), level))
    return rounded(rows.select("trace_id", F.posexplode("v").alias("frame", "value")))


@query(with_sql("tframes", then="SELECT trace_id, CAST(frame AS INT) AS frame, round((intensity - avg(intensity) OVER w) / CASE WHEN stddev_pop(intensity) OVER w = 0 THEN 1 ELSE stddev_pop(intensity) OVER w END, 6) + 0.0 AS value FROM tframes WINDOW w AS (PARTITION BY trace_id)"))
def h5_zscore(spark, sf_dir):
    return rounded(X.traces(spark, sf_dir).select("trace_id", F.posexplode(normalize.zscore(F.col("values"))).alias("frame", "value")))


@query(with_sql("tframes", then=_MINMAX + " SELECT trace_id, CAST(frame AS INT) AS frame, round(v, 6) AS value FROM n"))
def h6_minmax(spark, sf_dir):
    return rounded(X.traces(spark, sf_dir).select("trace_id", F.posexplode(normalize.minmax(F.col("values"))).alias("frame", "value")))


@query(with_sql("tframes", then=_MINMAX + ", z AS (SELECT *, (intensity - avg(intensity) OVER w) / stddev_pop(intensity) OVER w AS z FROM n WINDOW w AS (PARTITION BY trace_id)) SELECT trace_id, class_idx, 2 AS n_channels, CAST(count(*) AS BIGINT) AS frames, round(sum(v), 6) AS sum_0, round(sum(z * frame), 6) AS sum_1 FROM z WHERE frame < 64 - 4 GROUP BY 1, 2"))
def a13_build_dataset(spark, sf_dir):
    rows = normalize.normalizations(X.traces(spark, sf_dir), F.lit(0.0))
    found = normalize.dataset(rows, ["minmax", "zscored"], 4)
    weighted = arrays.total(F.transform(F.get("channels", F.lit(1)), lambda v, i: v * i))
    return rounded(found.select("trace_id", "class_idx", F.size("channels").alias("n_channels"), F.size(F.get("channels", F.lit(0))).cast("long").alias("frames"), arrays.total(F.get("channels", F.lit(0))).alias("sum_0"), weighted.alias("sum_1")))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, CAST(run AS INT) AS run, s AS \"start\", e AS \"end\", CAST(width AS INT) AS width, peak AS peak_frame FROM r"))
def e1_runs(spark, sf_dir):
    return dwell.runs(on_frames(spark, sf_dir)).select("trace_id", "run", "start", "end", "width", "peak_frame")


@query(with_sql("frames", then="f AS (SELECT *, intensity > 25 AS is_on FROM frames), " + _RUNS.format(width=3) + " SELECT trace_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(s * (run + 1)) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM r GROUP BY 1"))
def e1_runs_array_form(spark, sf_dir):
    on = F.transform("values", lambda v: v > ON_LEVEL)
    rows = X.long_traces(spark, sf_dir).withColumn("r", dwell.array_runs(on, 3))
    found = rows.select("trace_id", F.posexplode("r").alias("i", "r"))
    return found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r.start") * (F.col("i") + 1)).alias("starts"), F.sum("r.end").alias("ends"))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, CAST(run AS INT) AS run, peak AS peak_frame FROM r WHERE width >= 2"))
def e2_peaks(spark, sf_dir):
    return dwell.runs(on_frames(spark, sf_dir)).where("width >= 2").select("trace_id", "run", "peak_frame")


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, CAST(run AS INT) AS run, CAST(off AS INT) AS \"off\" FROM r"))
def e3_off_times(spark, sf_dir):
    return dwell.off_times(dwell.runs(on_frames(spark, sf_dir))).select("trace_id", "run", F.col("off").cast("int").alias("off"))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, CAST(count(*) AS INT) AS n_peaks, min(peak) AS first_peak, max(peak) AS last_peak, CASE WHEN count(*) > 1 THEN list_sort(list(peak))[2] - list_sort(list(peak))[1] ELSE -1 END AS delta_first_second FROM r GROUP BY 1"))
def e4_peak_summary(spark, sf_dir):
    return dwell.peak_summary(dwell.runs(on_frames(spark, sf_dir)))


@query(with_sql("frames", then="f AS (SELECT *, intensity > 25 AS is_on FROM frames), " + _RUNS.format(width=2) + ", g AS (SELECT trace_id, max(e) - min(s) + 1 AS win FROM r GROUP BY 1) SELECT trace_id, round(count(*) FILTER (WHERE is_on) * 1.0 / any_value(win), 6) AS duty_cycle FROM f LEFT JOIN g USING (trace_id) GROUP BY 1"))
def e5_duty_cycle(spark, sf_dir):
    return rounded(dwell.features(on_frames(spark, sf_dir), 2).select("trace_id", "duty_cycle"))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, count(*) AS n_runs, round(avg(width), 6) AS mean_on, round(avg(off), 6) AS mean_off, round(avg(m), 6) AS mean_intensity FROM r GROUP BY 1"))
def e6_dwell_means(spark, sf_dir):
    return rounded(dwell.features(on_frames(spark, sf_dir)).select("trace_id", "n_runs", "mean_on", "mean_off", "mean_intensity"))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, round(avg(width * 10.0), 6) AS mean_on_ms, round(avg(off * 10.0), 6) AS mean_off_ms, round(coalesce(stddev_samp(width * 10.0::DOUBLE), 0), 6) AS std_on_ms, round(coalesce(stddev_samp(off * 10.0::DOUBLE), 0), 6) AS std_off_ms, round(sum(width * 10.0), 6)::DOUBLE AS total_on_ms, round(sum(off * 10.0), 6)::DOUBLE AS total_off_ms FROM r GROUP BY 1 HAVING count(*) >= 2"))
def e7_forest_features(spark, sf_dir):
    return rounded(dwell.forest_features(on_frames(spark, sf_dir), FRAME_MS))


@query(with_sql("movie_paths", then="SELECT path, compound, row_number() OVER (PARTITION BY compound ORDER BY path) - 1 AS trace_id FROM (SELECT DISTINCT path, split_part(path, '/', 2) AS compound FROM movie_paths)"))
def e8_unique_ids(spark, sf_dir):
    from ..operators.sampling import numbered

    rows = X.movie_paths(spark, sf_dir).distinct().withColumn("compound", F.split("path", "/")[1])
    return numbered(rows, "compound", ["path"]).select("path", "compound", "trace_id")


_PEAKS = """f AS MATERIALIZED (SELECT trace_id, frame, intensity AS x FROM frames), n AS (SELECT trace_id, any_value(class_idx) AS class_idx, count(*) AS n, {height} AS height FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS all_frames FROM frames) GROUP BY 1),
 c AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS turn FROM f WINDOW w AS (PARTITION BY trace_id ORDER BY frame)), g AS (SELECT *, sum(turn) OVER (PARTITION BY trace_id ORDER BY frame) AS flat FROM c),
 t AS (SELECT trace_id, flat, any_value(x) AS h, min(frame) AS s, max(frame) AS e FROM g GROUP BY 1, 2),
 pk AS (SELECT trace_id, (s + e) // 2 AS peak, h FROM t QUALIFY h > lag(h) OVER (PARTITION BY trace_id ORDER BY flat) AND h > lead(h) OVER (PARTITION BY trace_id ORDER BY flat)),
 tall AS (SELECT pk.*, n FROM pk JOIN n USING (trace_id) WHERE h >= height),
 lr AS (SELECT trace_id, peak, h, coalesce(max(frame) FILTER (frame < peak AND x > h) + 1, 0) AS l, coalesce(min(frame) FILTER (frame > peak AND x > h) - 1, n - 1) AS r FROM tall JOIN f USING (trace_id) GROUP BY trace_id, peak, h, n),
 mm AS (SELECT trace_id, peak, h, first(frame ORDER BY x, frame DESC) FILTER (frame <= peak) AS lm, first(frame ORDER BY x, frame) FILTER (frame >= peak) AS rm, h - (h - greatest(min(x) FILTER (frame <= peak), min(x) FILTER (frame >= peak))) / 2 AS level FROM lr JOIN f USING (trace_id) WHERE frame BETWEEN l AND r GROUP BY 1, 2, 3),
 ab AS (SELECT trace_id, peak, level, max(frame) FILTER (frame <= peak AND x <= level) AS i, min(frame) FILTER (frame >= peak AND x <= level) AS j FROM mm JOIN f USING (trace_id) WHERE frame BETWEEN lm AND rm GROUP BY 1, 2, 3),
 wd AS (SELECT ab.trace_id, j - CASE WHEN b.x < level THEN (level - b.x) / (b1.x - b.x) ELSE 0 END - (i + CASE WHEN a.x < level THEN (level - a.x) / (a1.x - a.x) ELSE 0 END) AS width
  FROM ab JOIN f a ON a.trace_id = ab.trace_id AND a.frame = i JOIN f b ON b.trace_id = ab.trace_id AND b.frame = j LEFT JOIN f a1 ON a1.trace_id = ab.trace_id AND a1.frame = i + 1 LEFT JOIN f b1 ON b1.trace_id = ab.trace_id AND b1.frame = j - 1)
 SELECT trace_id, class_idx, CAST(count(width) FILTER (width >= 2) AS INT) AS n_peaks FROM n LEFT JOIN wd USING (trace_id) GROUP BY 1, 2"""


@query(with_sql("frames", then=_PEAKS.format(height="stddev_samp(intensity) / 2")))
def e11_local_peaks(spark, sf_dir):
    return X.long_traces(spark, sf_dir).select("trace_id", "class_idx", peaks.peak_count(F.col("values")).alias("n_peaks"))


@query(with_sql("frames", then=_PEAKS.format(height="3 * stddev_samp(intensity) FILTER (WHERE frame >= all_frames - 50)")))
def e11_peaks_over_the_tail(spark, sf_dir):
    return X.long_traces(spark, sf_dir).select("trace_id", "class_idx", peaks.peak_count(F.col("values"), height="tail").alias("n_peaks"))


@query(with_sql("frames", then="f AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM frames) SELECT trace_id, round(avg(intensity) FILTER (WHERE frame >= n - 500), 6) AS tail_mean, round(stddev_samp(intensity) FILTER (WHERE frame >= n - 50), 6) AS tail_std, round(coalesce(stddev_samp(intensity) / nullif(stddev_samp(intensity) FILTER (WHERE frame >= n - 50), 0), 0), 6) AS snr FROM f GROUP BY 1"))
def e12_tail_statistics(spark, sf_dir):
    return rounded(gates.tail_statistics(X.long_traces(spark, sf_dir)))


@query(with_sql("frames", then=_FRAME_RUNS + ", l AS (SELECT trace_id, count(*) AS n FROM frames GROUP BY 1), b AS (SELECT trace_id, first(s ORDER BY m DESC, run) AS s, first(e ORDER BY m DESC, run) AS e FROM r GROUP BY 1), m AS (SELECT trace_id, n, least(40, n) AS w, coalesce((s + e) // 2, n // 2) AS centre FROM l LEFT JOIN b USING (trace_id)) SELECT trace_id, CAST(centre AS INT) AS centre, CAST(least(greatest(0, centre - 20), n - w) AS INT) AS window_start, CAST(least(greatest(0, centre - 20), n - w) + w AS INT) AS window_end FROM m"))
def e13_highest_peak_window(spark, sf_dir):
    f = on_frames(spark, sf_dir)
    found = dwell.runs(f, 1, ("trace_id",), (F.avg("intensity").alias("run_intensity"),))
    return dwell.highest_run_window(found, f.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("length")), 40)


@query(with_sql("frames", then="""p AS (SELECT trace_id, avg(intensity) AS mu, min(intensity) AS lo, max(intensity) AS hi FROM frames GROUP BY 1),
 s0 AS (SELECT f.trace_id, f.intensity AS v, CASE WHEN f.intensity <= (lo + hi) / 2 THEN 1.0::DOUBLE ELSE 0.0 END AS p0 FROM frames f JOIN p USING (trace_id)),
 t0 AS (SELECT trace_id, sum(p0) + 1e-12 AS n0, sum(1 - p0) + 1e-12 AS n1, count(*) AS n, sum(p0 * v) AS a0, sum((1 - p0) * v) AS a1, sum(p0 * v * v) AS q0, sum((1 - p0) * v * v) AS q1 FROM s0 GROUP BY 1),
 m0 AS (SELECT trace_id, a0/n0 AS mean0, a1/n1 AS mean1, q0/n0 - (a0/n0)*(a0/n0) + 1e-6 AS var0, q1/n1 - (a1/n1)*(a1/n1) + 1e-6 AS var1, n0/n AS w FROM t0),
 s1 AS (SELECT trace_id, f.intensity AS v, 1 - 1 / (1 + exp((ln(w) - 0.5*ln(var0) - (f.intensity-mean0)*(f.intensity-mean0)/(2*var0)) - (ln(1-w) - 0.5*ln(var1) - (f.intensity-mean1)*(f.intensity-mean1)/(2*var1)))) AS p0 FROM frames f JOIN m0 USING (trace_id)),
 t1 AS (SELECT trace_id, sum(p0) + 1e-12 AS n0, sum(1 - p0) + 1e-12 AS n1, count(*) AS n, sum(p0 * v) AS a0, sum((1 - p0) * v) AS a1, sum(p0 * v * v) AS q0, sum((1 - p0) * v * v) AS q1 FROM s1 GROUP BY 1)
 SELECT trace_id, round(a0/n0, 6) AS mean0, round(a1/n1, 6) AS mean1, round(q0/n0 - (a0/n0)*(a0/n0) + 1e-6, 6) AS var0, round(q1/n1 - (a1/n1)*(a1/n1) + 1e-6, 6) AS var1, round(n0/n, 6) AS weight0 FROM t1"""))
def h1_relational_em(spark, sf_dir):
    return rounded(mixture.em_steps(X.frames(spark, sf_dir), 1))


@query(_mixture_sql("frames", " SELECT trace_id, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round(var0, 6) AS var0, round(var1, 6) AS var1, round(weight0, 6) AS weight0, round(separation, 6) AS separation FROM mx"))
def h1_mixture(spark, sf_dir):
    rows = mixture.with_mixture(X.long_traces(spark, sf_dir))
    return rounded(rows.select("trace_id", "mixture.*", mixture.separation(F.col("mixture")).alias("separation")))


@query(_mixture_sql("frames", " SELECT trace_id, round(mean0, 6) AS level FROM mx"))
def h2_background_level(spark, sf_dir):
    rows = mixture.with_mixture(X.long_traces(spark, sf_dir))
    return rounded(rows.select("trace_id", mixture.background_level(F.col("mixture"), F.col("values")).alias("level")))


@query(_mixture_sql("frames", " SELECT trace_id, CAST(count(*) FILTER (WHERE separation < 1 OR p < 1 - 0.9::DOUBLE) AS INT) AS noise, CAST(count(*) FILTER (WHERE separation >= 1 AND p >= 1 - 0.9::DOUBLE AND p < 0.9) AS INT) AS overlap, CAST(count(*) FILTER (WHERE separation >= 1 AND p >= 0.9) AS INT) AS signal FROM po GROUP BY 1"))
def h3_frame_classes(spark, sf_dir):
    rows = mixture.with_mixture(X.long_traces(spark, sf_dir)).withColumn("c", mixture.classes(F.col("values"), F.col("mixture"), 0.9, 1.0))
    return rows.select("trace_id", *[F.size(F.filter("c", lambda x: x == k)).alias(k) for k in ("noise", "overlap", "signal")])  # noqa: B023


@query(with_sql("frames", then="SELECT trace_id, round(avg(intensity), 6) AS mean, round(stddev_samp(intensity), 6) AS std, max(intensity) AS max, min(intensity) AS min FROM frames GROUP BY 1"))
def d3_trace_statistics(spark, sf_dir):
    return rounded(gates.frame_statistics(X.long_traces(spark, sf_dir)).select("trace_id", "mean", "std", "max", "min"))


_ROBUST = "m AS (SELECT trace_id, quantile_cont(intensity, 0.5) AS med, max(intensity) AS hi FROM frames GROUP BY 1), d AS (SELECT trace_id, any_value(med) AS med, any_value(hi) AS hi, quantile_cont(abs(intensity - med), 0.5) AS mad FROM frames JOIN m USING (trace_id) GROUP BY 1)"


@query(with_sql("frames", then=_ROBUST + " SELECT trace_id, round(med, 6) AS median, round(mad, 6) AS mad, round((hi - med) / greatest(mad, 1e-10), 6) AS score FROM d"))
def d4_robust_score(spark, sf_dir):
    rows = X.long_traces(spark, sf_dir)
    return rounded(gates.frame_statistics(rows).select("trace_id", "median", "mad").join(rows.select("trace_id", gates.robust_score(F.col("values")).alias("score")), "trace_id"))


@query(with_sql("frames", then=_ROBUST + " SELECT trace_id FROM d WHERE (hi - med) / greatest(mad, 1e-10) <= 1.95"))
def b4_robust_filter(spark, sf_dir):
    return gates.robust_filter(X.long_traces(spark, sf_dir), 1.95).select("trace_id")


@query(with_sql("frames", then=_ROBUST + ", k AS (SELECT trace_id FROM d WHERE (hi - med) / greatest(mad, 1e-10) <= 1.95) SELECT trace_id, norm FROM k, (SELECT unnest(['raw', 'bg_rm', 'zscored', 'minmax']) AS norm)"))
def b5_keep_list(spark, sf_dir):
    rows = X.long_traces(spark, sf_dir)
    return gates.keep_list(normalize.normalizations(rows, F.lit(0.0)), gates.robust_filter(rows, 1.95), ["trace_id"]).select("trace_id", "norm")


@query(_mixture_sql("frames", " SELECT trace_id, round(separation, 6) AS separation FROM mx WHERE separation >= 3.2"))
def b6_snr_gate(spark, sf_dir):
    rows = mixture.with_mixture(X.long_traces(spark, sf_dir)).withColumn("separation", mixture.separation(F.col("mixture")))
    return rounded(rows.where(gates.snr_gate(F.col("separation"), gates.Gates(snr_min=3.2))).select("trace_id", "separation"))


@query(with_sql("frames", then="SELECT trace_id FROM frames GROUP BY 1 HAVING avg(CASE WHEN intensity > 25 THEN 1.0 ELSE 0 END) <= 0.5"))
def b7_duty_gate(spark, sf_dir):
    on = F.transform("values", lambda v: v > ON_LEVEL)
    return X.long_traces(spark, sf_dir).where(gates.duty_gate(gates.duty_cycle(on), gates.Gates())).select("trace_id")


_GATES = gates.Gates(min_peaks=120, first_before=3, gap_below=4, last_after=560)
_SUMMARY = _FRAME_RUNS + ", p AS (SELECT trace_id, count(*) AS n_peaks, min(peak) AS first_peak, max(peak) AS last_peak, CASE WHEN count(*) > 1 THEN list_sort(list(peak))[2] - list_sort(list(peak))[1] ELSE -1 END AS delta FROM r GROUP BY 1)"


@query(with_sql("frames", then=_SUMMARY + " SELECT trace_id, CAST(n_peaks AS INT) AS n_peaks FROM p WHERE n_peaks > 120 AND first_peak < 3 AND delta < 4 AND last_peak > 560"))
def b8_peak_gates(spark, sf_dir):
    found = dwell.peak_summary(dwell.runs(on_frames(spark, sf_dir)))
    return found.where(gates.peak_gate(_GATES)).select("trace_id", "n_peaks")


@query(with_sql("frames", then=_SUMMARY + " SELECT trace_id, array_to_string(list_filter([CASE WHEN n_peaks <= 120 THEN 'n_peaks=' || n_peaks || ' <= 120' END, CASE WHEN n_peaks = 0 THEN 'n_peaks=0' END, CASE WHEN n_peaks > 0 AND first_peak >= 3 THEN 'first_peak=' || first_peak || ' >= 3' END, CASE WHEN n_peaks < 2 THEN 'n_peaks=' || n_peaks || ' < 2 (cannot check delta)' END, CASE WHEN n_peaks > 1 AND delta >= 4 THEN 'delta_1-2=' || delta || ' >= 4' END, CASE WHEN n_peaks > 0 AND last_peak <= 560 THEN 'last_peak=' || last_peak || ' <= 560' END], lambda x: x IS NOT NULL), ';') AS reasons FROM p"))
def b9_gate_reasons(spark, sf_dir):
    found = dwell.peak_summary(dwell.runs(on_frames(spark, sf_dir)))
    return found.select("trace_id", F.array_join(gates.failures(_GATES), ";").alias("reasons"))


@query(with_sql("frames", "traces", then="SELECT trace_id, count(*) AS frames FROM frames WHERE trace_id IN (SELECT trace_id FROM traces) GROUP BY 1"))
def b11_common_traces(spark, sf_dir):
    rows = normalize.common_traces(X.frames(spark, sf_dir), X.traces(spark, sf_dir), ["trace_id"])
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("frames"))


@query(with_sql("frames", then="t AS (SELECT trace_id, class_idx, avg(CASE WHEN intensity > 25 THEN 1.0 ELSE 0 END) <= 0.5 AS ok FROM frames GROUP BY 1, 2) SELECT class_idx, count(*) AS before, count(*) FILTER (WHERE ok) AS after, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS percent FROM t GROUP BY 1"))
def d5_passed_share(spark, sf_dir):
    on = F.transform("values", lambda v: v > ON_LEVEL)
    rows = X.long_traces(spark, sf_dir).withColumn("ok", gates.duty_cycle(on) <= 0.5)
    return rounded(gates.passed_share(rows, F.col("ok"), ["class_idx"]).withColumn("after", F.col("after").cast("long")))


@query(with_sql("frames", then=_FRAME_RUNS + " SELECT trace_id, CAST(run AS INT) AS run, width * 10.0::DOUBLE AS on_ms, off * 10.0::DOUBLE AS off_ms FROM r"))
def h19_to_ms(spark, sf_dir):
    found = dwell.off_times(dwell.runs(on_frames(spark, sf_dir)))
    return found.select("trace_id", "run", normalize.to_ms(F.col("width"), FRAME_MS).alias("on_ms"), normalize.to_ms(F.col("off"), FRAME_MS).alias("off_ms"))


@query(_mixture_sql("tframes", " SELECT trace_id, round(avg(CASE WHEN separation >= 1 AND p >= 0.8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS duty FROM po GROUP BY 1"))
def j1_per_trace_function(spark, sf_dir):
    """A function of whole traces in Arrow batches (the mixture), then its frames' share of signal."""
    rows = mixture.with_mixture(X.traces(spark, sf_dir))
    return rounded(rows.select("trace_id", gates.duty_cycle(mixture.on_mask(F.col("values"), F.col("mixture"), 0.8, 1.0)).alias("duty")))


@query(_mixture_sql("frames", """,
 f AS (SELECT trace_id, frame, x AS intensity, separation >= 2 AND p >= 0.8 AS is_on FROM po), """ + _RUNS.format(width=2) + """,
 k AS (SELECT trace_id, CAST(count(*) AS INT) AS n_peaks, CAST(first(peak ORDER BY run) AS INT) AS first_peak, CAST(max(peak) AS INT) AS last_peak, CAST(CASE WHEN count(*) > 1 THEN list_sort(list(peak))[2] - list_sort(list(peak))[1] ELSE -1 END AS INT) AS delta_first_second FROM r GROUP BY 1),
 t AS (SELECT trace_id, avg(CASE WHEN is_on THEN 1.0::DOUBLE ELSE 0 END) AS duty, avg(intensity) AS mean, stddev_samp(intensity) AS std, max(intensity) AS max, min(intensity) AS min FROM f GROUP BY 1),
 d AS (SELECT t.*, separation, coalesce(n_peaks, 0) AS n_peaks, coalesce(first_peak, -1) AS first_peak, coalesce(last_peak, -1) AS last_peak, coalesce(delta_first_second, -1) AS delta_first_second FROM t JOIN mx USING (trace_id) LEFT JOIN (SELECT k.* FROM k JOIN mx USING (trace_id) WHERE separation >= 3) k USING (trace_id)),
 w AS (SELECT *, array_to_string(list_filter([CASE WHEN n_peaks <= 20 THEN 'n_peaks=' || n_peaks || ' <= 20' END, CASE WHEN n_peaks = 0 THEN 'n_peaks=0' END, CASE WHEN n_peaks > 0 AND first_peak >= 30 THEN 'first_peak=' || first_peak || ' >= 30' END, CASE WHEN n_peaks < 2 THEN 'n_peaks=' || n_peaks || ' < 2 (cannot check delta)' END, CASE WHEN n_peaks > 1 AND delta_first_second >= 30 THEN 'delta_1-2=' || delta_first_second || ' >= 30' END, CASE WHEN n_peaks > 0 AND last_peak <= 500 THEN 'last_peak=' || last_peak || ' <= 500' END], lambda z: z IS NOT NULL), ';') AS reasons FROM d)
 SELECT trace_id, round(separation, 6) AS separation, round(duty, 6) AS duty, n_peaks, first_peak, last_peak, delta_first_second, round(mean, 6) AS mean, round(std, 6) AS std, max, min, reasons, reasons = '' AS passed, CASE WHEN trace_id % 3 = 0 THEN 'Unknown' ELSE 'Exp' || (trace_id % 3) END AS experiment FROM w"""))
def j3_diagnostics(spark, sf_dir):
    rows = X.long_traces(spark, sf_dir)
    experiments = rows.where("trace_id % 3 > 0").select("trace_id", F.concat(F.lit("Exp"), (F.col("trace_id") % 3).cast("string")).alias("experiment"))
    found = gates.diagnose(rows, gates.Gates(snr_min=3.0, min_peaks=20, first_before=30, gap_below=30, last_after=500, min_width=2), 0.8, 2.0, experiments)
    return rounded(found.withColumn("reasons", F.array_join("reasons", ";")))
