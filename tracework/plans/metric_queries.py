"""Queries over predictions, certainty, folds, samples and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import certainty, metrics, sampling, stats
from ..sources import fixtures as X
from ..sources.fixtures import with_sql
from .registry import query, rounded

CLASSES = 2


def predictions(spark, sf_dir):
    """sample_id, label, probs, score, pred: the means over the passes."""
    rows = X.predictions_mc(spark, sf_dir).groupBy("sample_id", "label").agg(F.avg("prob1").alias("p"))
    rows = rows.select("sample_id", "label", F.array(1 - F.round("p", 9), F.round("p", 9)).alias("probs"))
    return rows.withColumn("score", F.get("probs", F.lit(1))).withColumn("pred", arrays.argmax(F.col("probs")))


def long_passes(spark, sf_dir):
    rows = X.predictions_mc(spark, sf_dir)
    return rows.select("sample_id", "label", "pass", F.posexplode(F.array(1 - F.col("prob1"), F.col("prob1"))).alias("class", "prob"))


_P = "p AS (SELECT sample_id, label, round(avg(prob1), 9) AS score FROM predictions_mc GROUP BY 1, 2), q AS (SELECT *, CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS pred FROM p)"
_CELLS = "cells AS (SELECT l.label, m.pred, count(q.sample_id) AS n FROM (SELECT unnest([0, 1]) AS label) l CROSS JOIN (SELECT unnest([0, 1]) AS pred) m LEFT JOIN q ON q.label = l.label AND q.pred = m.pred GROUP BY 1, 2)"
_RATES = _CELLS + ", t AS (SELECT c.k AS class, coalesce(sum(n) FILTER (WHERE label = c.k AND pred = c.k), 0) AS tp, coalesce(sum(n) FILTER (WHERE label = c.k), 0) AS support, coalesce(sum(n) FILTER (WHERE pred = c.k), 0) AS predicted FROM (SELECT unnest([0, 1]) AS k) c CROSS JOIN cells GROUP BY 1), v AS (SELECT *, CASE WHEN predicted > 0 THEN tp * 1.0::DOUBLE / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp * 1.0::DOUBLE / support ELSE 0 END AS recall FROM t), w AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM v)"
_AUC = "a AS (SELECT score, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM q), auc AS (SELECT (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * 1.0::DOUBLE * sum(1 - label)) AS auc FROM a)"
_CURVE = "c0 AS (SELECT score, sum(label) AS p, count(*) AS c FROM q GROUP BY 1), cv AS (SELECT score, CAST(sum(p) OVER o AS BIGINT) AS tp, CAST(sum(c - p) OVER o AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos, CAST(sum(c - p) OVER () AS BIGINT) AS neg FROM c0 WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
_PR = _CURVE + ", s AS (SELECT *, tp * 1.0::DOUBLE / (tp + fp) AS pr, tp * 1.0::DOUBLE / pos AS re FROM cv), tr AS (SELECT (re - lag(re, 1, 0) OVER o) * (pr + lag(pr, 1, 1) OVER o) / 2 AS step FROM s WINDOW o AS (ORDER BY score DESC)), pa AS (SELECT sum(step) AS pr_auc FROM tr)"
_LOSS = "ll AS (SELECT avg(-ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-15))) AS log_loss FROM q)"
_WD = "x AS (SELECT sample_id, label, avg(prob1) AS m, list_sort(list(prob1)) AS b, list_sort(list(1 - prob1)) AS a FROM predictions_mc GROUP BY 1, 2), wd AS (SELECT sample_id, label, CASE WHEN m > 1 - m THEN 1 ELSE 0 END AS pred, list_sum(list_transform(range(1, 21), lambda i: abs(a[i] - b[i]))) / 20 AS wd FROM x)"


def _sweep_sql(top: str, steps: int, value: str, source: str, op: str = ">") -> str:
    return f"""th AS (SELECT i AS threshold_no, i * {top} / {steps - 1} AS threshold FROM (SELECT unnest(range({steps})) AS i)),
 k AS (SELECT threshold_no, threshold, label, count(*) FILTER (WHERE {value} {op} threshold) AS n, count(*) FILTER (WHERE {value} {op} threshold AND label = pred) AS h FROM th CROSS JOIN {source} GROUP BY 1, 2, 3),
 sw AS (SELECT threshold_no, threshold, CAST(sum(n) AS BIGINT) AS kept, sum(n) * 1.0::DOUBLE / (SELECT count(*) FROM {source}) AS kept_share, CASE WHEN sum(n) > 0 THEN sum(h) * 1.0::DOUBLE / sum(n) END AS accuracy, CASE WHEN count(*) FILTER (WHERE n > 0) >= 2 THEN avg(h * 1.0::DOUBLE / n) FILTER (WHERE n > 0) END AS balanced_accuracy FROM k GROUP BY 1, 2)"""


_SWEEP_COLS = " SELECT CAST(threshold_no AS INT) AS threshold_no, round(threshold, 6) AS threshold, kept, round(kept_share, 6) AS kept_share, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM sw"
_WD_SWEEP = _WD + ", " + _sweep_sql("(SELECT max(wd) FROM wd)", 50, "wd", "wd")


@query(with_sql("predictions_mc", then=_P + " SELECT label, count(*) AS n FROM p GROUP BY 1"))
def d6_class_counts(spark, sf_dir):
    return metrics.class_counts(predictions(spark, sf_dir))


@query(with_sql("predictions_mc", then=_P + ", " + _CELLS + " SELECT label, pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY label) ELSE 0 END, 6) AS share FROM cells"))
def d7_confusion(spark, sf_dir):
    return rounded(metrics.confusion(predictions(spark, sf_dir), CLASSES))


_FOLD_CELLS = "f AS (SELECT *, sample_id % 4 + 1 AS fold FROM q), cells AS (SELECT g.fold, l.label, m.pred, count(f.sample_id) AS n FROM (SELECT DISTINCT fold FROM f) g CROSS JOIN (SELECT unnest([0, 1]) AS label) l CROSS JOIN (SELECT unnest([0, 1]) AS pred) m LEFT JOIN f ON f.fold = g.fold AND f.label = l.label AND f.pred = m.pred GROUP BY 1, 2, 3), sh AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY fold, label) > 0 THEN n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY fold, label) ELSE 0 END AS share FROM cells)"


@query(with_sql("predictions_mc", then=_P + ", " + _FOLD_CELLS + " SELECT label, pred, round(avg(share), 6) AS mean, round(coalesce(stddev_samp(share), 0), 6) AS std FROM sh GROUP BY 1, 2"))
def d8_mean_confusion(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("fold", F.col("sample_id") % 4 + 1)
    return rounded(metrics.mean_confusion(metrics.confusion(rows, CLASSES, ["fold"]), []))


@query(with_sql("predictions_mc", then=_P + ", " + _FOLD_CELLS + " SELECT 'even' AS model, label, pred, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE fold % 2 = 0 GROUP BY 2, 3 UNION ALL SELECT 'odd', label, pred, CAST(sum(n) AS BIGINT) FROM cells WHERE fold % 2 = 1 GROUP BY 2, 3"))
def g4_union_confusions(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("fold", F.col("sample_id") % 4 + 1)
    cells = metrics.confusion(rows, CLASSES, ["fold"]).withColumn("odd", F.col("fold") % 2 == 1)
    part = lambda name, test: cells.where(test).groupBy(F.lit(name).alias("model"), "label", "pred").agg(F.sum("n").alias("n"))
    return part("even", ~F.col("odd")).unionByName(part("odd", F.col("odd")))


@query(with_sql("fold_metrics", then="SELECT model, aug_factor, count(*) AS n_folds, round(avg(auc), 6) AS mean_auc, round(avg(bal_acc), 6) AS mean_bal_acc, round(stddev_pop(auc), 6) AS std_auc, round(stddev_pop(bal_acc), 6) AS std_bal_acc FROM fold_metrics GROUP BY 1, 2"))
def d9_fold_summary(spark, sf_dir):
    return rounded(metrics.fold_summary(X.fold_metrics(spark, sf_dir), ["model", "aug_factor"], ["auc", "bal_acc"]))


@query(with_sql("predictions_mc", then=_P + ", " + _RATES + " SELECT CAST(class AS VARCHAR) AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM w UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM w UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM w"))
def d10_report(spark, sf_dir):
    return rounded(metrics.report(metrics.class_rates(metrics.confusion(predictions(spark, sf_dir), CLASSES))))


@query(with_sql("predictions_mc", then=_P + " SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM q"))
def d11_accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_P + ", rc AS (SELECT label, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) AS r FROM q GROUP BY 1) SELECT 'skip' AS absent, round(CASE WHEN count(*) >= 2 THEN avg(r) END, 6) AS balanced_accuracy FROM rc UNION ALL SELECT 'zero', round(sum(r) / 3, 6) FROM rc"))
def d12_balanced_accuracy(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    one = lambda absent, n: metrics.balanced_accuracy(rows, n, absent).select(F.lit(absent).alias("absent"), "balanced_accuracy")
    return rounded(one("skip", 2).unionByName(one("zero", 3)))


@query(with_sql("predictions_mc", then=_P + ", t AS (SELECT sum(label * pred)::DOUBLE AS tp, sum((1 - label) * pred)::DOUBLE AS fp, sum((1 - label) * (1 - pred))::DOUBLE AS tn, sum(label * (1 - pred))::DOUBLE AS fn FROM q) SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS youden, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(least(tp / (tp + fn), tn / (tn + fp)), 6) AS min_recall FROM t"))
def d13_binary_scores(spark, sf_dir):
    y, p = F.col("label"), F.col("pred")
    sums = predictions(spark, sf_dir).agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum((1 - y) * (1 - p)).alias("tn"), F.sum(y * (1 - p)).alias("fn"))
    return rounded(sums.select(*[v.alias(k) for k, v in metrics.binary_scores(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]).items()]))


@query(with_sql("predictions_mc", then=_P + ", " + _AUC + " SELECT round(auc, 6) AS auc FROM auc"))
def d14_auc(spark, sf_dir):
    return rounded(metrics.auc(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_P + ", " + _AUC + " SELECT round(auc, 6) AS auc FROM auc"))
def d14_macro_auc(spark, sf_dir):
    return rounded(metrics.macro_auc(predictions(spark, sf_dir), CLASSES))


@query(with_sql("predictions_mc", then=_P + ", " + _PR + " SELECT round(pr_auc, 6) AS pr_auc FROM pa"))
def d15_pr_auc(spark, sf_dir):
    return rounded(metrics.pr_auc(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_P + ", " + _LOSS + " SELECT round(log_loss, 6) AS log_loss FROM ll"))
def d16_log_loss(spark, sf_dir):
    return rounded(metrics.log_loss(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_P + " SELECT label, 0 AS class, round(avg(1 - score), 6) AS mean, round(stddev_pop(1 - score) / sqrt(count(*)), 6) AS sem FROM q GROUP BY 1 UNION ALL SELECT label, 1, round(avg(score), 6), round(stddev_pop(score) / sqrt(count(*)), 6) FROM q GROUP BY 1"))
def d17_mean_probabilities(spark, sf_dir):
    return rounded(metrics.mean_probabilities(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_P + ", " + _CURVE + " SELECT round(score, 6) AS score, tp, fp, pos, neg FROM cv"))
def e10_curve(spark, sf_dir):
    return rounded(metrics.curve(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then="SELECT sample_id, CAST(pass AS INT) AS pass, CASE WHEN prob1 > 1 - prob1 THEN 1 ELSE 0 END AS pred, round(greatest(prob1, 1 - prob1), 6) AS prob FROM predictions_mc"))
def e15_argmax(spark, sf_dir):
    return rounded(metrics.argmax_rows(long_passes(spark, sf_dir), ["sample_id", "pass"]))


@query(with_sql("predictions_mc", then=_P + ", " + _RATES + ", " + _AUC + ", " + _PR + ", " + _LOSS + " SELECT round((SELECT avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) FROM q), 6) AS accuracy, round((SELECT avg(recall) FROM w), 6) AS balanced_accuracy, round((SELECT auc FROM auc), 6) AS auc, round((SELECT pr_auc FROM pa), 6) AS pr_auc, round((SELECT log_loss FROM ll), 6) AS log_loss, round((SELECT avg(f1) FROM w), 6) AS macro_f1"))
def j9_evaluation(spark, sf_dir):
    return rounded(metrics.evaluation(predictions(spark, sf_dir)))


@query(with_sql("predictions_mc", then=_WD + " SELECT sample_id, label, pred, round(wd, 6) AS wd FROM wd"))
def h7_certainty(spark, sf_dir):
    return rounded(certainty.certainty(long_passes(spark, sf_dir)))


@query(with_sql("two_class_values", then="""o AS (SELECT class_name, value, row_number() OVER (PARTITION BY class_name ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY class_name) AS n FROM two_class_values),
 g AS (SELECT unnest(range((SELECT max(n) FROM o))) AS k), m AS (SELECT max(n) AS m FROM o),
 z AS (SELECT k, c.class_name, (k + 0.5::DOUBLE) / m * (c.n - 1) AS place FROM g, m, (SELECT DISTINCT class_name, n FROM o) c),
 y AS (SELECT z.k, z.class_name, a.value + (place - floor(place)) * (b.value - a.value) AS v FROM z JOIN o a ON a.class_name = z.class_name AND a.i = floor(place) JOIN o b ON b.class_name = z.class_name AND b.i = least(floor(place) + 1, b.n - 1))
 SELECT round(avg(d), 6) AS distance FROM (SELECT k, abs(max(v) FILTER (WHERE class_name = 'click') - max(v) FILTER (WHERE class_name = 'view')) AS d FROM y GROUP BY 1)"""))
def h8_wasserstein(spark, sf_dir):
    return rounded(certainty.wasserstein_rows(X.two_class_values(spark, sf_dir), "class_name", "click", "view"))


@query(with_sql("predictions_mc", then=_WD_SWEEP + _SWEEP_COLS))
def h9_certainty_sweep(spark, sf_dir):
    return rounded(certainty.sweep(certainty.certainty(long_passes(spark, sf_dir)), "wd", None))


@query(with_sql("predictions_mc", then=_P + ", mg AS (SELECT *, abs(2 * score - 1) AS margin FROM q), " + _sweep_sql("1.0::DOUBLE", 50, "margin", "mg") + _SWEEP_COLS))
def h10_margin_sweep(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("margin", F.abs(2 * F.col("score") - 1))
    return rounded(certainty.sweep(rows, "margin", 1.0))


def _binary_sql(steps: int) -> str:
    return f"""th AS (SELECT i AS threshold_no, i * 1.0::DOUBLE / {steps - 1} AS threshold FROM (SELECT unnest(range({steps})) AS i)),
 t AS (SELECT threshold_no, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < threshold AND label = 0)::DOUBLE AS tn, count(*) FILTER (WHERE score < threshold AND label = 1)::DOUBLE AS fn FROM th CROSS JOIN q GROUP BY 1, 2),
 s AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM t)"""


@query(with_sql("predictions_mc", then=_P + ", " + _binary_sql(101) + " SELECT first(threshold ORDER BY round(mcc, 12) DESC, threshold) AS threshold, round(max(mcc), 6) AS value FROM s"))
def h11_binary_threshold(spark, sf_dir):
    return rounded(certainty.best_binary_threshold(predictions(spark, sf_dir), "mcc"))


@query(with_sql("predictions_mc", then=_P + """, e AS (SELECT 1 AS class, score AS s, label AS hit FROM q UNION ALL SELECT 0, 1 - score, 1 - label FROM q),
 n AS (SELECT class, hit, least(100, floor(s * 100 + 1e-12)) AS place FROM e), th AS (SELECT unnest(range(101)) AS t),
 t AS (SELECT class, t, count(*) FILTER (WHERE place >= t AND hit = 1)::DOUBLE AS tp, count(*) FILTER (WHERE place >= t AND hit = 0)::DOUBLE AS fp, count(*) FILTER (WHERE place < t AND hit = 0)::DOUBLE AS tn, count(*) FILTER (WHERE place < t AND hit = 1)::DOUBLE AS fn FROM th CROSS JOIN n GROUP BY 1, 2),
 s AS (SELECT class, t, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM t)
 SELECT CAST(class AS INT) AS class, round(first(t ORDER BY round(mcc, 12) DESC, t) / 100.0::DOUBLE, 6) AS threshold, round(first(mcc ORDER BY round(mcc, 12) DESC, t), 6) AS value FROM s GROUP BY 1"""))
def h12_class_thresholds(spark, sf_dir):
    return rounded(certainty.best_class_thresholds(predictions(spark, sf_dir)))


_THREE = """, r AS (SELECT CASE WHEN pass % 4 = 0 THEN 2 ELSE label END AS label, exp(2 - 2 * prob1) AS a, exp(2 * prob1) AS b, exp((sample_id % 10) / 5.0::DOUBLE) AS c FROM predictions_mc),
 k AS (SELECT label, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred, greatest(a, b, c) / (a + b + c) AS top FROM r),
 th AS (SELECT i, i * 0.02::DOUBLE AS threshold FROM (SELECT unnest(range(51)) AS i)),
 n AS (SELECT i, threshold, class, count(*) FILTER (WHERE label = class AND pred = class) AS tp, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE pred = class) AS predicted FROM th JOIN k ON top >= threshold, (SELECT unnest(range(3)) AS class) GROUP BY 1, 2, 3),
 m AS (SELECT th.i, th.threshold, coalesce(avg(CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END) FILTER (WHERE n.i IS NOT NULL), 0) AS macro_f1, coalesce(avg(tp * 1.0::DOUBLE / support) FILTER (WHERE support > 0), 0) AS balanced_accuracy, coalesce(CAST(sum(support) AS BIGINT), 0) AS kept FROM th LEFT JOIN n ON th.i = n.i GROUP BY 1, 2)"""


def three_classes(spark, sf_dir):
    """Every stochastic pass as a prediction over three classes."""
    rows = X.predictions_mc(spark, sf_dir)
    scores = F.array(2 - 2 * F.col("prob1"), 2 * F.col("prob1"), (F.col("sample_id") % 10) / F.lit(5.0))
    return rows.select(F.when(F.col("pass") % 4 == 0, 2).otherwise(F.col("label")).alias("label"), arrays.softmax(scores).alias("probs"))


@query(with_sql("predictions_mc", then=_THREE[2:] + " SELECT CAST(i AS INT) AS threshold_no, round(threshold, 6) AS threshold, kept, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM m"))
def h12_confidence_sweep(spark, sf_dir):
    return rounded(certainty.confidence_sweep(three_classes(spark, sf_dir), 3))


@query(with_sql("predictions_mc", then=_THREE[2:] + """ SELECT 'macro_f1' AS metric, round(first(threshold ORDER BY round(macro_f1, 12) DESC, i), 6) AS threshold, round(max(macro_f1), 6) AS value FROM m
 UNION ALL SELECT 'balanced_accuracy', round(first(threshold ORDER BY round(balanced_accuracy, 12) DESC, i), 6), round(max(balanced_accuracy), 6) FROM m"""))
def h12_global_threshold(spark, sf_dir):
    rows = three_classes(spark, sf_dir)
    each = [certainty.best_confidence_threshold(rows, 3, m).withColumn("metric", F.lit(m)) for m in ("macro_f1", "balanced_accuracy")]
    return rounded(each[0].unionByName(each[1]).select("metric", "threshold", "value"))


@query(with_sql("predictions_mc", then=_P + " SELECT sample_id, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS binary_class, CASE WHEN greatest(score, 1 - score) >= 0.7 THEN pred ELSE -1 END AS class_or_none FROM q"))
def h13_apply_threshold(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.select("sample_id", certainty.apply_threshold(F.col("probs"), 0.6, 2).alias("binary_class"), certainty.apply_threshold(F.col("probs"), [0.7, 0.7], 2).alias("class_or_none"))


@query(with_sql("predictions_mc", then=_P + ", " + _binary_sql(501) + " SELECT first(threshold ORDER BY round(accuracy, 12) DESC, threshold) AS threshold, round(max(accuracy), 6) AS value FROM s"))
def h14_accuracy_threshold(spark, sf_dir):
    return rounded(certainty.best_binary_threshold(predictions(spark, sf_dir), "accuracy", 501))


@query(with_sql("predictions_mc", then="SELECT sample_id, CAST(pass AS INT) AS pass, round(exp(prob1) / (exp(prob1) + exp(1 - prob1) + exp(0.5)), 6) AS p FROM predictions_mc"))
def h23_softmax(spark, sf_dir):
    rows = X.predictions_mc(spark, sf_dir)
    return rounded(rows.select("sample_id", "pass", F.get(arrays.softmax(F.array("prob1", 1 - F.col("prob1"), F.lit(0.5))), F.lit(0)).alias("p")))


@query(with_sql("predictions_mc", then=_WD + " SELECT label, count(*) AS n FROM wd WHERE wd >= 0.2 GROUP BY 1"))
def b10_certainty_filter(spark, sf_dir):
    return certainty.certainty(long_passes(spark, sf_dir)).where("wd >= 0.2").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("predictions_mc", then=_WD_SWEEP + " SELECT round(coalesce(first(threshold ORDER BY balanced_accuracy DESC, threshold_no), 0), 6) AS threshold, round(max(balanced_accuracy), 6) AS value FROM sw WHERE 1 - kept_share <= 0.5 AND balanced_accuracy IS NOT NULL"))
def f11_choose_threshold(spark, sf_dir):
    return rounded(certainty.choose(certainty.sweep(certainty.certainty(long_passes(spark, sf_dir)), "wd", None)))


@query(with_sql("predictions_mc", then=_WD + ", f AS (SELECT *, sample_id % 4 + 1 AS fold FROM wd), th AS (SELECT unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS threshold), k AS (SELECT fold, threshold, count(*) FILTER (WHERE wd > threshold) AS n, count(*) FILTER (WHERE wd > threshold AND label = pred) AS h, count(*) AS t FROM th CROSS JOIN f GROUP BY 1, 2) SELECT threshold, round(avg(100.0 * n / t), 6) AS kept_percent, round(avg(h * 1.0::DOUBLE / n), 6) AS accuracy, round(coalesce(stddev_samp(h * 1.0::DOUBLE / n), 0), 6) AS std, count(*) AS n_folds FROM k WHERE n > 0 GROUP BY 1"))
def d22_sweep_summary(spark, sf_dir):
    rows = certainty.certainty(long_passes(spark, sf_dir)).withColumn("fold", F.col("sample_id") % 4 + 1)
    limits = spark.createDataFrame([(t,) for t in (0.0, 0.1, 0.2, 0.3)], "threshold double")
    kept = F.col("wd") > F.col("threshold")
    each = rows.crossJoin(F.broadcast(limits)).groupBy("fold", "threshold").agg((100.0 * F.avg(kept.cast("double"))).alias("percent"), F.avg(F.when(kept, (F.col("label") == F.col("pred")).cast("double"))).alias("acc"))
    found = each.where("acc is not null").groupBy("threshold").agg(F.avg("percent").alias("kept_percent"), F.avg("acc").alias("accuracy"), F.coalesce(F.stddev_samp("acc"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n_folds"))
    return rounded(found)


@query(with_sql("predictions_mc", then=_P + ", b AS (SELECT least(39, floor(abs(2 * score - 1) / 0.025::DOUBLE))::INT AS bin FROM q) SELECT CAST(g AS INT) AS bin, count(b.bin) AS n FROM (SELECT unnest(range(40)) AS g) LEFT JOIN b ON b.bin = g GROUP BY 1"))
def d21_histogram(spark, sf_dir):
    return stats.histogram(predictions(spark, sf_dir).withColumn("margin", F.abs(2 * F.col("score") - 1)), "margin")


@query(with_sql("two_class_values", then="e AS (SELECT class_name, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM two_class_values GROUP BY 1 HAVING count(*) >= 2) SELECT round(min(a) - 0.05 * (max(b) - min(a)), 6) AS range_low, round(max(b) + 0.05 * (max(b) - min(a)), 6) AS range_high FROM e"))
def d23_coverage_range(spark, sf_dir):
    return rounded(stats.coverage_range(X.two_class_values(spark, sf_dir), "class_name", "value"))


@query(with_sql("tframes", then="SELECT class_idx, count(DISTINCT trace_id) AS traces, count(*) AS n, round(avg(intensity), 6) + 0.0 AS mean FROM tframes GROUP BY 1"))
def d24_flatten_lists(spark, sf_dir):
    return rounded(stats.flatten_lists(X.traces(spark, sf_dir), "class_idx", "values"))


@query(with_sql("fold_metrics", then="SELECT model, " + ", ".join(f"round(avg(auc) FILTER (WHERE aug_factor = {i}), 6) AS mean_{i}, round(stddev_pop(auc) FILTER (WHERE aug_factor = {i}), 6) AS std_{i}" for i in range(3)) + " FROM fold_metrics GROUP BY 1"))
def d25_heatmap(spark, sf_dir):
    return rounded(stats.heatmap(X.fold_metrics(spark, sf_dir), "model", "aug_factor", [0, 1, 2], "auc"))


@query(with_sql("two_class_values", then="a AS (SELECT class_name, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM two_class_values), s AS (SELECT sum(r) FILTER (WHERE class_name = 'click') AS r1, count(*) FILTER (WHERE class_name = 'click')::DOUBLE AS n1, count(*) FILTER (WHERE class_name = 'view')::DOUBLE AS n2 FROM a) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS r FROM s"))
def h18_mann_whitney(spark, sf_dir):
    return rounded(stats.mann_whitney(X.two_class_values(spark, sf_dir), "class_name", "click").drop("p"))


@query("""WITH RECURSIVE v AS (SELECT user_id, event_type = 'click' AS a, CAST(value AS DOUBLE) AS v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
 c AS (SELECT user_id, v, count(*) AS c, count(*) FILTER (WHERE a) AS a FROM v GROUP BY 1, 2),
 k AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY v) - (c - 1) / 2.0::DOUBLE AS rank FROM c),
 s AS (SELECT user_id, sum(rank * a) AS r1, sum(a)::DOUBLE AS n1, sum(c - a)::DOUBLE AS n2, sum(c * c * c - c)::DOUBLE AS ties FROM k GROUP BY 1),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, least(n1, n2)::BIGINT AS m, (n1 + n2)::BIGINT AS n FROM s WHERE n1 >= 2 AND n2 >= 2),
 w AS (SELECT 0 AS n, 0 AS m, 0 AS total, 1::DOUBLE AS ways
   UNION ALL SELECT n + 1, m + d, total + d * (n + 1), sum(ways) FROM w, (SELECT unnest([0, 1]) AS d) WHERE n < (SELECT max(n) FROM u WHERE m <= 8) AND m + d <= 8 GROUP BY n, m + d, total + d * (n + 1)),
 e AS (SELECT user_id, sum(ways) FILTER (WHERE total - w.m * (w.m + 1) / 2 <= least(u, n1 * n2 - u)) / sum(ways) AS tail FROM u JOIN w USING (n, m) GROUP BY 1),
 z AS (SELECT *, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) / sqrt(2) AS x FROM u),
 p AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 150), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2) + lgamma(k + 1)))) END AS normal FROM z)
 SELECT user_id, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(1 - 2 * u / (n1 * n2), 6) AS r, round(least(1, CASE WHEN ties = 0 AND m <= 8 THEN 2 * tail ELSE normal END), 6) AS p FROM p LEFT JOIN e USING (user_id)""")
def h18_rank_tests_by_user(spark, sf_dir):
    """A test for every user; those with at most eight clicks or views and no ties have exact p-values."""
    rows = X.table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").selectExpr("user_id", "event_type", "CAST(value AS DOUBLE) AS value")
    return rounded(stats.mann_whitney(rows, "event_type", "click", keys=["user_id"]).where("u is not null"))


def _tests(spark, sf_dir):
    return X.fold_metrics(spark, sf_dir).groupBy("aug_factor").agg(F.avg("auc").alias("a")).select("aug_factor", F.round((F.col("aug_factor") + 1) / 50 + F.col("a") / 100, 9).alias("p"))


@query(with_sql("fold_metrics", then="t AS (SELECT aug_factor, round((aug_factor + 1) / 50.0::DOUBLE + avg(auc) / 100, 9) AS p FROM fold_metrics GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM t) SELECT aug_factor, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM k"))
def e9_benjamini_hochberg(spark, sf_dir):
    return rounded(stats.benjamini_hochberg(_tests(spark, sf_dir)))


@query(with_sql("fold_metrics", then="SELECT DISTINCT model, aug_factor, CASE WHEN aug_factor = 0 THEN 'none' ELSE concat('x', aug_factor) END AS label FROM fold_metrics"))
def g5_distinct_labels(spark, sf_dir):
    f = F.col("aug_factor")
    return X.fold_metrics(spark, sf_dir).select("model", "aug_factor", F.when(f == 0, "none").otherwise(F.concat(F.lit("x"), f.cast("string"))).alias("label")).distinct().orderBy("model", "aug_factor")


@query(with_sql("fold_metrics", then="s AS (SELECT model, aug_factor, avg(auc) AS m FROM fold_metrics GROUP BY 1, 2) SELECT model, aug_factor, round(m, 6) AS mean_auc FROM s ORDER BY round(m, 9) DESC, model, aug_factor LIMIT 1"))
def f12_best_combination(spark, sf_dir):
    rows = X.fold_metrics(spark, sf_dir).groupBy("model", "aug_factor").agg(F.avg("auc").alias("mean_auc"))
    return rounded(rows.orderBy(F.desc(F.round("mean_auc", 9)), "model", "aug_factor").limit(1))


@query(with_sql("fold_metrics", then="m AS (SELECT DISTINCT model FROM fold_metrics), f AS (SELECT DISTINCT aug_factor FROM fold_metrics) SELECT model, aug_factor FROM m CROSS JOIN f"))
def c9_sweep_product(spark, sf_dir):
    rows = X.fold_metrics(spark, sf_dir)
    return rows.select("model").distinct().crossJoin(F.broadcast(rows.select("aug_factor").distinct()))


def _ranked_sql(salt: str, table: str = "labels", seed: int = 42) -> str:
    return f"k AS (SELECT doc_id, CAST(quality AS INT) AS quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat('{seed}:{salt}:', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM {table})"


def _labels(spark, sf_dir):
    return X.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("WITH " + _ranked_sql("split") + " SELECT doc_id, quality, CASE WHEN r <= round(0.7::DOUBLE * n) THEN 'train' WHEN r <= round(0.85::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM k")
def f1_split_three(spark, sf_dir):
    return sampling.stratified_split(_labels(spark, sf_dir), "quality", "doc_id", {"train": 0.7, "val": 0.15, "test": 0.15})


@query("WITH " + _ranked_sql("split") + " SELECT doc_id, quality, CASE WHEN r <= round(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM k")
def f2_split_two(spark, sf_dir):
    return sampling.stratified_split(_labels(spark, sf_dir), "quality", "doc_id", {"train": 0.8, "test": 0.2})


@query("WITH " + _ranked_sql("fold") + " SELECT doc_id, quality, CAST((r - 1) % 4 + 1 AS INT) AS fold FROM k")
def f3_folds(spark, sf_dir):
    return sampling.stratified_folds(_labels(spark, sf_dir), "quality", "doc_id", 4)


@query("WITH " + _ranked_sql("balance") + " SELECT doc_id, quality FROM k WHERE r <= (SELECT min(n) FROM k)")
def f4_balance(spark, sf_dir):
    return sampling.balance(_labels(spark, sf_dir), "quality", "doc_id")


@query("WITH " + _ranked_sql("cap") + " SELECT doc_id, quality FROM k WHERE r <= 40")
def f5_cap(spark, sf_dir):
    return sampling.cap(_labels(spark, sf_dir), "quality", "doc_id", 40)


@query("WITH " + _ranked_sql("resample") + ", c AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS class_no, max(n) AS n, count(*) OVER () AS k FROM k GROUP BY quality), d AS (SELECT i AS draw, CAST('0x' || substr(md5(concat('42:class:', i)), 1, 8) AS BIGINT) / 4294967296.0 AS u, CAST('0x' || substr(md5(concat('42:member:', i)), 1, 8) AS BIGINT) / 4294967296.0 AS v FROM (SELECT unnest(range(500)) AS i)) SELECT draw, k.quality, k.doc_id FROM d JOIN c ON c.class_no = floor(d.u * c.k) JOIN k ON k.quality = c.quality AND k.r = floor(d.v * c.n) + 1")
def f6_resample(spark, sf_dir):
    return sampling.resample(_labels(spark, sf_dir), "quality", "doc_id", 500)


@query("WITH a AS (SELECT doc_id, CAST(quality AS INT) AS quality, row_number() OVER (ORDER BY md5(concat('42:scramble/to:', doc_id)), doc_id) AS r FROM labels), b AS (SELECT CAST(quality AS INT) AS scrambled, row_number() OVER (ORDER BY md5(concat('42:scramble/from:', doc_id)), doc_id) AS r FROM labels) SELECT doc_id, quality, scrambled FROM a JOIN b USING (r)")
def f7_scramble(spark, sf_dir):
    return sampling.scramble(_labels(spark, sf_dir), "quality", "doc_id")


@query("WITH " + _ranked_sql("pick") + " SELECT doc_id, quality FROM k WHERE r <= 5")
def f8_pick(spark, sf_dir):
    return sampling.pick(_labels(spark, sf_dir), ["quality"], "doc_id", 5)


@query(with_sql("movie_paths", then="d AS (SELECT DISTINCT split_part(path, '/', 2) AS protein, path FROM movie_paths), k AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY md5(concat('42:movie:', path)), path) AS r FROM d) SELECT protein, path FROM k WHERE r = 1"))
def f10_movie_per_protein(spark, sf_dir):
    rows = X.movie_paths(spark, sf_dir).distinct().select(F.split("path", "/")[1].alias("protein"), "path")
    return sampling.pick(rows, ["protein"], "path", 1, salt="movie")


@query("WITH " + _ranked_sql("fold") + " SELECT doc_id, CAST((r - 1) % 4 + 1 AS INT) AS fold FROM k WHERE (r - 1) % 4 + 1 = floor(CAST('0x' || substr(md5('42:display'), 1, 8) AS BIGINT) / 4294967296.0 * 4) + 1")
def f14_display_fold(spark, sf_dir):
    rows = sampling.stratified_folds(_labels(spark, sf_dir), "quality", "doc_id", 4)
    return rows.where(F.col("fold") == sampling.display_fold(42, 4)).select("doc_id", "fold")
