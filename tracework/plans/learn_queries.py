"""Queries that augment traces, fit models and follow training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import augment, certainty, dwell, learn, metrics, mixture, normalize, sampling, stats
from ..sources import fixtures as X
from ..sources.fixtures import with_sql
from ..sources.scratch import cut
from .registry import query, rounded
from .trace_queries import _RUNS, FRAME_MS, _mixture_sql, on_frames

TREES = 500


def _features(spark, sf_dir):
    """Two classes of short traces: even and odd labels."""
    return learn.trace_features(X.traces(spark, sf_dir)).withColumn("class_idx", F.col("class_idx") % 2)


def _test_bundle(scored):
    acc = metrics.accuracy(scored)
    return rounded(acc.crossJoin(metrics.auc(scored.withColumn("score", F.get("probs", F.lit(1))))).crossJoin(scored.agg(F.count(F.lit(1)).alias("n_test"))))


@query(with_sql("traces", then="SELECT -1 AS trace_id, class_idx, CAST(len(values) AS INT) AS frames FROM traces"))
def a14_background_dataset(spark, sf_dir):
    rows = normalize.normalizations(X.traces(spark, sf_dir), F.lit(0.0))
    found = normalize.dataset(rows, ["raw"])
    return found.select(F.lit(-1).alias("trace_id"), "class_idx", F.size(F.get("channels", F.lit(0))).alias("frames"))


@query(with_sql("tframes", then="SELECT trace_id, CAST(frame AS INT) AS frame, intensity FROM (SELECT trace_id, frame, coalesce(max(CASE WHEN intensity > 0.1 THEN frame END) OVER w, 63) AS l, coalesce(min(CASE WHEN intensity > 0.1 THEN frame END) OVER w, 0) AS f FROM tframes WINDOW w AS (PARTITION BY trace_id)) p JOIN (SELECT trace_id AS t, frame AS g, round(intensity, 6) AS intensity FROM tframes) v ON v.t = p.trace_id AND v.g = CASE WHEN p.frame BETWEEN p.f AND p.l THEN p.f + p.l - p.frame ELSE p.frame END"))
def h16_mirror(spark, sf_dir):
    rows = X.traces(spark, sf_dir).withColumn("m", augment.mirror(F.col("values"), F.transform("values", lambda v: v > 0.1)))
    return rounded(rows.select("trace_id", F.posexplode("m").alias("frame", "intensity")))


def _normal_sql(salt: str, ids: str) -> str:
    u = lambda n: f"(CAST('0x' || substr(md5(concat('42:{salt}/{n}:', {ids})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2 * ln(greatest({u(1)}, 1e-12))) * cos({u(2)} * 6.283185307179586))"


def _interpolated_sql(values: str, length: str) -> str:
    """A list at ``length`` evenly spaced places."""
    at = f"least(len({values}) - 1, i * ((len({values}) - 1) / ({length} - 1)))"
    return f"list_transform(range({length}), lambda i: {values}[CAST(floor({at}) AS INT) + 1] + ({at} - floor({at})) * ({values}[least(CAST(floor({at}) AS INT) + 2, len({values}))] - {values}[CAST(floor({at}) AS INT) + 1]))"


@query(with_sql("traces", then=f"""c AS (SELECT trace_id, copy, values AS v, CAST(floor(len(values) * greatest(0.95::DOUBLE, least(1.05::DOUBLE, 1 + 0.03::DOUBLE * {_normal_sql("warp", "trace_id, ':', copy")}))) AS BIGINT) AS n, greatest(0.95::DOUBLE, least(1.05::DOUBLE, 1 + 0.02::DOUBLE * {_normal_sql("scale", "trace_id, ':', copy")})) AS f FROM traces, (SELECT unnest([1, 2]) AS copy)),
 w AS (SELECT *, {_interpolated_sql("v", "n")} AS w FROM c), b AS (SELECT *, {_interpolated_sql("w", "len(v)")} AS b FROM w),
 s AS (SELECT *, sqrt(list_sum(list_transform(b, lambda x: (x - list_avg(b)) ** 2)) / len(b)) AS s FROM b),
 o AS (SELECT trace_id, copy, (x + 0.02::DOUBLE * s * {_normal_sql("noise", "trace_id, ':', copy, ':', frame")}) * f AS x FROM (SELECT trace_id, copy, s, f, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS frame FROM s))
 SELECT trace_id, copy, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std FROM o GROUP BY 1, 2"""))
def h15_augment(spark, sf_dir):
    rows = augment.augmented(X.traces(spark, sf_dir), 3)
    return rounded(rows.select("trace_id", "copy", arrays.mean(F.col("values")).alias("mean"), arrays.std(F.col("values")).alias("std")))


@query(with_sql("traces", then="k AS (SELECT trace_id, (row_number() OVER (PARTITION BY class_idx ORDER BY md5(concat('42:fold:', trace_id)), trace_id) - 1) % 4 + 1 AS fold FROM traces) SELECT CAST(fold AS INT) AS fold, CAST(copy AS INT) AS copy, count(*) AS n FROM k, (SELECT unnest([-1, 0, 1, 2]) AS copy) WHERE fold <> 2 GROUP BY 1, 2"))
def h17_training_rows(spark, sf_dir):
    placed = sampling.stratified_folds(X.traces(spark, sf_dir), "class_idx", "trace_id", 4)
    rows = augment.training_rows(placed, 2, 3, mirrored=True, on=F.transform("values", lambda v: v > 0.1))
    return rows.groupBy("fold", "copy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n, CAST(unnest(range(3)) AS INT) AS copy FROM (SELECT count(*) AS n FROM embeddings)")
def g3_union_copies(spark, sf_dir):
    rows = X.traces(spark, sf_dir).withColumn("copy", F.lit(0))
    return rows.unionByName(augment.augmented(X.traces(spark, sf_dir), 3)).groupBy("copy").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("epochs", then="""w AS (SELECT DISTINCT run, 0 AS epoch, '-inf'::DOUBLE AS best_auc, 'inf'::DOUBLE AS low, 'inf'::DOUBLE AS taken, 0 AS best, 0 AS waited, 0 AS stop FROM epochs
 UNION ALL SELECT run, epoch, CASE WHEN take THEN greatest(best_auc, val_auc) ELSE best_auc END, low, CASE WHEN take THEN val_loss ELSE taken END, CASE WHEN take THEN epoch ELSE best END, CASE WHEN take THEN 0 ELSE waited + 1 END, CASE WHEN stop = 0 AND NOT take AND waited + 1 >= 5 THEN epoch ELSE stop END
 FROM (SELECT *, stop = 0 AND ((val_auc >= best_auc + 0.005 AND val_loss <= low * 1.1) OR (best_auc > '-inf'::DOUBLE AND val_auc >= best_auc - 0.003 AND val_loss <= taken - 0.005)) AS take
  FROM (SELECT w.run, e.epoch, e.val_auc, e.val_loss, w.best_auc, least(w.low, e.val_loss) AS low, w.taken, w.best, w.waited, w.stop FROM w JOIN epochs e ON e.run = w.run AND e.epoch = w.epoch + 1))),
 z AS (SELECT run, max(epoch) AS epoch FROM w GROUP BY 1)
 SELECT w.run, w.best AS best_epoch, round(w.best_auc, 6) AS best_auc, CASE WHEN w.stop > 0 THEN w.stop END AS stop_epoch FROM w JOIN z ON w.run = z.run AND w.epoch = z.epoch""").replace("WITH ", "WITH RECURSIVE ", 1))
def e14_early_stop(spark, sf_dir):
    """The usual limits, with a patience of five epochs."""
    return rounded(learn.early_stop(X.epochs(spark, sf_dir), patience=5))


DWELL = ("mean_on_ms", "mean_off_ms", "std_on_ms", "std_off_ms", "total_on_ms", "total_off_ms")


def _dwell(spark, sf_dir):
    """Two classes of long traces by their six dwell features."""
    return dwell.forest_features(on_frames(spark, sf_dir), FRAME_MS).withColumn("class_idx", (F.col("trace_id") % 2).cast("int"))


@query()
def f13_importances(spark, sf_dir):
    model, _ = learn.classify(_dwell(spark, sf_dir), DWELL, "class_idx", "trace_id", learn.forest(TREES))
    return rounded(learn.importances(spark, model, DWELL))


_SHARED_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5(concat('42:{salt}:', trace_id)), trace_id) AS r{n}, count(*) OVER (PARTITION BY {by}) AS n{n}"


@query(with_sql("traces", then="k AS (SELECT trace_id, CAST(class_idx % 2 AS INT) AS class_idx FROM traces), s AS (SELECT *, " + _SHARED_RANK.format(by="class_idx", salt="split", n=1) + " FROM k), p AS (SELECT trace_id, class_idx, CASE WHEN r1 <= round(0.8::DOUBLE * n1) THEN 'train' ELSE 'test' END AS split FROM s), b AS (SELECT *, " + _SHARED_RANK.format(by="split, class_idx", salt="balance", n=2) + " FROM p) SELECT trace_id, class_idx, split FROM b WHERE r2 <= (SELECT min(n2) FROM b b2 WHERE b2.split = b.split)"))
def j4_split_and_balanced(spark, sf_dir):
    """What the forests learn from and are tested on."""
    rows = X.traces(spark, sf_dir).select("trace_id", (F.col("class_idx") % 2).cast("int").alias("class_idx"))
    return learn.split_and_balanced(rows, "class_idx", "trace_id")


@query()
def j4_forest(spark, sf_dir):
    return _test_bundle(learn.classify(_features(spark, sf_dir), learn.TRACE_FEATURES, "class_idx", "trace_id", learn.forest(TREES))[1])


@query()
def j4_forest_on_dwell_features(spark, sf_dir):
    return _test_bundle(learn.classify(_dwell(spark, sf_dir), DWELL, "class_idx", "trace_id", learn.forest(TREES))[1])


@query()
def j5_scrambled_control(spark, sf_dir):
    return _test_bundle(learn.scrambled_control(_dwell(spark, sf_dir), DWELL, "class_idx", "trace_id", learn.forest(TREES)))


@query()
def j6_noise_control(spark, sf_dir):
    """A model of half of the traces scores flat background: the distribution over classes should have no bias."""
    rows = cut(_dwell(spark, sf_dir))
    model, _ = learn.classify(rows.where("trace_id % 3 > 0"), DWELL, "class_idx", "trace_id", learn.forest(TREES))
    return rounded(metrics.mean_probabilities(learn.score(model, rows.where("trace_id % 3 = 0"), DWELL, "class_idx")))


_MASK = "CAST('0x' || substr(md5(concat('42:mask:', pass, ':', trace_id, ':', frame)), 1, 8) AS BIGINT) / 4294967296.0"


@query(with_sql("tframes", then=f"""k AS (SELECT trace_id, CAST(class_idx % 2 AS INT) AS label, pass, frame, CASE WHEN {_MASK} >= 0.2 THEN intensity / 0.8::DOUBLE ELSE 0 END AS v FROM tframes, (SELECT unnest(range(20)) AS pass)),
 s AS (SELECT trace_id, label, pass, sum(v * (frame % 5 - 2)) / 4 + 0.1 AS s0, sum(v * (frame % 3 - 1)) / 2 AS s1 FROM k GROUP BY 1, 2, 3),
 p AS (SELECT trace_id, label, exp(s1) / (exp(s0) + exp(s1)) AS prob1 FROM s),
 x AS (SELECT trace_id, label, avg(prob1) AS m, list_sort(list(prob1)) AS b, list_sort(list(1 - prob1)) AS a FROM p GROUP BY 1, 2)
 SELECT trace_id, label, CASE WHEN m > 1 - m THEN 1 ELSE 0 END AS pred, round(list_sum(list_transform(range(1, 21), lambda i: abs(a[i] - b[i]))) / 20, 6) AS wd FROM x"""))
def j7_stochastic_predictions(spark, sf_dir):
    """A fixed linear scorer of all 64 frames, twenty passes with dropped inputs."""
    rows = X.traces(spark, sf_dir).select("trace_id", (F.col("class_idx") % 2).cast("int").alias("label"), F.col("values").alias("x"))
    weights = [[(i % 5 - 2) / 4 for i in range(64)], [(i % 3 - 1) / 2 for i in range(64)]]
    passes = learn.stochastic_passes(rows, weights, [0.1, 0.0], 20)
    return rounded(certainty.certainty(passes, ["trace_id", "label"]))


@query()
def j7_forest_votes(spark, sf_dir):
    """The trees of a forest as passes: the certainty of every trace of the test part."""
    model, tested = learn.classify(_dwell(spark, sf_dir), DWELL, "class_idx", "trace_id", learn.forest(TREES))
    votes = learn.forest_votes(model, tested.drop("label"), DWELL, "class_idx")
    return rounded(certainty.certainty(votes, ["trace_id", "label"]))


@query()
def j8_cross_validation(spark, sf_dir):
    """Three models by three augmentation factors by four folds. Forests of 50 trees, as there are twelve of them."""
    rows = X.traces(spark, sf_dir).withColumn("class_idx", F.col("class_idx") % 2)
    scored = learn.cross_validate(rows, 4, [0, 3, 5], ["forest", "logistic", "perceptron"], 2, trees=50)
    return rounded(learn.fold_metrics(scored, 2))


def _tests_sql(values: str) -> str:
    """Normal rank tests of class 0 against the rest for each feature of ``values`` (feature, class_idx, value), adjusted over the features."""
    return f"""{values}, vc AS (SELECT feature, value AS v, count(*) AS c, count(*) FILTER (WHERE class_idx = 0) AS a FROM vals WHERE value IS NOT NULL GROUP BY 1, 2),
 vk AS (SELECT *, sum(c) OVER (PARTITION BY feature ORDER BY v) - (c - 1) / 2.0::DOUBLE AS rank FROM vc),
 vs AS (SELECT feature, sum(rank * a) AS r1, sum(a)::DOUBLE AS n1, sum(c - a)::DOUBLE AS n2, sum(c * c * c - c)::DOUBLE AS ties FROM vk GROUP BY 1),
 vu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM vs),
 vz AS (SELECT *, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) / sqrt(2) AS x FROM vu),
 vp AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 150), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2) + lgamma(k + 1)))) END AS p FROM vz),
 vr AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM vp)
 SELECT feature, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(1 - 2 * u / (n1 * n2), 6) AS r, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM vr"""


# The mixture's frames, their runs, the dwell features of every trace, then the tests. Values are rounded before they are ranked.
@query(_mixture_sql("frames", """, fc AS (SELECT DISTINCT trace_id, class_idx FROM frames), f AS (SELECT trace_id, frame, x AS intensity, separation >= 1 AND p >= 0.8 AS is_on FROM po), """ + _RUNS.format(width=1) + """,
 dw AS (SELECT trace_id, avg(width) AS mean_on, avg("off") AS mean_off, avg(m) AS mean_intensity, max(e) - min(s) + 1 AS win FROM r GROUP BY 1),
 duty AS (SELECT trace_id, count(*) FILTER (WHERE is_on) AS on_frames FROM f GROUP BY 1),
 ft AS (SELECT class_idx, mean_on * 10.0::DOUBLE AS mean_on, mean_off * 10.0::DOUBLE AS mean_off, on_frames * 1.0::DOUBLE / win AS duty_cycle, mean_intensity FROM fc JOIN duty USING (trace_id) LEFT JOIN dw USING (trace_id)),
 """ + _tests_sql("vals AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, class_idx, round({c}, 9) AS value FROM ft" for c in ("mean_on", "mean_off", "duty_cycle", "mean_intensity")) + ")")))
def j11_feature_analysis(spark, sf_dir):
    """Mixture, ON mask, dwell features in ms, a rank test of the two classes for each feature, adjusted p-values."""
    fitted = mixture.with_mixture(X.long_traces(spark, sf_dir))
    rows = fitted.withColumn("on", mixture.on_mask(F.col("values"), F.col("mixture"), 0.8, 1.0))
    frames = rows.select("trace_id", "class_idx", F.posexplode(F.arrays_zip("values", "on")).alias("frame", "z")).select("trace_id", "class_idx", "frame", F.col("z.values").alias("intensity"), F.col("z.on").alias("on"))
    found = dwell.features(frames, 1, ("trace_id", "class_idx"))
    names = ["mean_on", "mean_off", "duty_cycle", "mean_intensity"]
    long_ = found.select("class_idx", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(n) * (FRAME_MS if n in ("mean_on", "mean_off") else 1.0), 9).alias("value")) for n in names])).alias("f")).select(F.col("class_idx").cast("string").alias("class_name"), "f.*")
    return rounded(stats.benjamini_hochberg(stats.mann_whitney(long_, "class_name", "0", keys=["feature"])))
