"""Classification metrics as aggregates and windows over a prediction table.

Tables: label (int), pred (int), probs (array<double>) or score (double), with
any grouping keys. No metric needs a row-at-a-time function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, classes: int, keys: list[str] | None = None) -> DataFrame:
    """keys, label, pred, n, share (of the label's rows; 0 for a class without rows): every cell of classes x classes."""
    keys = keys or []
    spark = rows.sparkSession
    cells = spark.range(classes).select(F.col("id").cast("int").alias("label")).crossJoin(spark.range(classes).select(F.col("id").cast("int").alias("pred")))
    if keys:
        cells = rows.select(*keys).distinct().crossJoin(F.broadcast(cells))
    counts = rows.groupBy(*keys, F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(counts, [*keys, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = F.sum("n").over(W.partitionBy(*keys, "label"))
    return full.withColumn("share", F.when(of > 0, F.col("n") / of).otherwise(0.0))


def mean_confusion(cells: DataFrame, over: list[str]) -> DataFrame:
    """over, label, pred, mean, std (ddof 1; 0 of a single fold) of the shares over folds."""
    return cells.groupBy(*over, "label", "pred").agg(F.avg("share").alias("mean"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("std"))


def fold_summary(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, n_folds, mean_* and std_* (ddof 0)."""
    aggs = [F.avg(m).alias(f"mean_{m}") for m in measures] + [F.stddev_pop(m).alias(f"std_{m}") for m in measures]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def class_rates(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, class, tp, support, predicted, precision, recall, f1 (0 where undefined) from confusion counts."""
    keys = keys or []
    both = cells.select(*keys, F.col("label").alias("class"), (F.col("label") == F.col("pred")).cast("long").alias("hit"), "n", F.lit(1).alias("side")).unionByName(
        cells.select(*keys, F.col("pred").alias("class"), F.lit(0).cast("long").alias("hit"), "n", F.lit(2).alias("side")))
    sums = both.groupBy(*keys, "class").agg(F.sum(F.col("hit") * F.col("n")).alias("tp"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(rates: DataFrame) -> DataFrame:
    """name (class number, macro avg, weighted avg), precision, recall, f1, support."""
    cols = ["precision", "recall", "f1"]
    each = rates.select(F.col("class").cast("string").alias("name"), *cols, "support")
    macro = rates.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *cols, "support")
    weighted = rates.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("name"), *cols, "support")
    return each.unionByName(macro).unionByName(weighted)


def accuracy(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or [])).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(rows: DataFrame, classes: int, absent: str = "skip", keys: list[str] | None = None) -> DataFrame:
    """keys, balanced_accuracy. absent "skip": over the classes there are, NULL for fewer than two; "zero": over all, absent ones count 0."""
    keys = keys or []
    recall = rows.groupBy(*keys, "label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("recall"))
    value = F.when(F.count(F.lit(1)) >= 2, F.avg("recall")) if absent == "skip" else F.sum("recall") / classes
    return recall.groupBy(*keys).agg(value.alias("balanced_accuracy"))


def binary_scores(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """accuracy, mcc, f1, youden, balanced_accuracy, min_recall; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = lambda c: c.cast("double")
    tp, fp, tn, fn = d(tp), d(fp), d(tn), d(fn)
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "mcc": ratio(tp * tn - fp * fn, root), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "youden": tpr + tnr - 1, "balanced_accuracy": (tpr + tnr) / 2, "min_recall": F.least(tpr, tnr),
    }


def curve(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, score, tp, fp, pos, neg: one point a distinct score (label 0/1), from the highest down.

    Rows are first counted by score; the running counts are taken by ranges of the score.
    """
    points = _score_counts(rows, keys or [], F.desc("score"))
    return points.select(*(keys or []), "score", "tp", "fp", F.col("all_tp").alias("pos"), F.col("all_fp").alias("neg"))


def _score_counts(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """keys, score, p, q (rows of label 1 and 0 there), tp and fp (running), all_tp, all_fp."""
    counts = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), (F.count(F.lit(1)) - F.sum("label")).alias("q"))
    return running(counts, keys, [order], {"tp": "p", "fp": "q"})


def auc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, auc by average ranks, from counts of distinct scores; NULL where one class is missing."""
    keys = keys or []
    c = F.col("p") + F.col("q")
    ranked = _score_counts(rows, keys, F.asc("score")).withColumn("rank", F.col("tp") + F.col("fp") - (c - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("n1"), F.sum("q").cast("double").alias("n0"))
    return sums.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def macro_auc(rows: DataFrame, classes: int) -> DataFrame:
    """One row: auc, the mean of the one-versus-rest values over probs; NULL if a class is missing."""
    each = rows.select("label", F.posexplode("probs").alias("class", "score")).select("class", F.col("score"), (F.col("label") == F.col("class")).cast("int").alias("label"))
    return auc(each, ["class"]).agg(F.when(F.count("auc") == classes, F.avg("auc")).alias("auc"))


def pr_auc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, pr_auc: trapezoids over recall and precision, beginning at recall 0 and precision 1; NULL without a row of label 1.

    The point before is known from the running counts without those of its own score, so no second window is needed.
    """
    keys = keys or []
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("p"), fp - F.col("q")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    step = F.try_divide(F.col("p"), F.col("all_tp")) * (F.try_divide(tp, tp + fp) + before) / 2
    return _score_counts(rows, keys, F.desc("score")).withColumn("step", step).groupBy(*keys).agg(F.sum("step").alias("pr_auc"))


def log_loss(rows: DataFrame, keys: list[str] | None = None, floor: float = 1e-15) -> DataFrame:
    p = F.greatest(F.get("probs", F.col("label").cast("int")), F.lit(floor))
    return rows.groupBy(*(keys or [])).agg(F.avg(-F.log(p)).alias("log_loss"))


def mean_probabilities(rows: DataFrame) -> DataFrame:
    """label, class, mean, sem (population std over the root of n)."""
    each = rows.select("label", F.posexplode("probs").alias("class", "p"))
    return each.groupBy("label", "class").agg(F.avg("p").alias("mean"), (F.stddev_pop("p") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def argmax_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long probabilities (keys, class, prob) -> keys, pred (the first of the largest), prob."""
    best = F.max_by(F.struct("class", "prob"), F.struct("prob", (-F.col("class")).alias("c")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.class").alias("pred"), F.col("b.prob").alias("prob"))


def evaluation(rows: DataFrame, classes: int = 2) -> DataFrame:
    """One row of accuracy, balanced_accuracy, auc, pr_auc, log_loss, macro_f1 from label, pred and probs of two classes."""
    score = rows.withColumn("score", F.get("probs", F.lit(1)))
    macro = class_rates(confusion(rows, classes)).agg(F.avg("f1").alias("macro_f1"))
    parts = [balanced_accuracy(rows, classes, "zero"), auc(score), pr_auc(score), log_loss(rows), macro]
    out = accuracy(rows)
    for part in parts:  # one row each
        out = out.crossJoin(part)
    return out
