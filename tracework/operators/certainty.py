"""Certainty of repeated stochastic predictions, and threshold sweeps.

A sweep over m thresholds never joins rows with thresholds: each row is counted
in the bucket of the thresholds below its value, and suffix sums over the
buckets (m rows) give every threshold's counts in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..sources.scratch import cut
from . import metrics
from .ordered import running


def wasserstein_equal(a: Column, b: Column) -> Column:
    """Distance of two samples of one size: mean difference of the sorted values."""
    gaps = F.zip_with(F.sort_array(a), F.sort_array(b), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _quantile(ordered: Column, q: Column) -> Column:
    """Linear interpolation between the two values around place q (n - 1)."""
    n = F.size(ordered)
    at = q * (n - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, n - 1)
    return F.get(ordered, low) + (at - low) * (F.get(ordered, high) - F.get(ordered, low))


def wasserstein(a: Column, b: Column) -> Column:
    """Any sizes: mean difference of the quantiles (i + 0.5) / m, m being the larger size; an empty side counts as zeros, two as 0."""
    sides = F.struct(F.sort_array(a).alias("x"), F.sort_array(b).alias("y"), F.greatest(F.size(a), F.size(b)).alias("m"))
    gaps = arrays.let(sides, lambda s: F.transform(F.sequence(F.lit(0), s["m"] - 1), lambda i: F.abs(_quantile(s["x"], (i + 0.5) / s["m"]) - _quantile(s["y"], (i + 0.5) / s["m"]))))
    one = lambda v: F.aggregate(F.transform(v, lambda z: F.abs(z)), F.lit(0.0), lambda s, z: s + z) / F.size(v)
    full = arrays.mean(gaps)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when(F.size(a) == 0, one(b)).when(F.size(b) == 0, one(a)).otherwise(full)


def wasserstein_rows(rows: DataFrame, group: str, first: str, second: str, value: str = "value") -> DataFrame:
    """One row: distance, as wasserstein gives it, of two groups of rows of any size: values are ranked by ranges and joined on the rank.

    Each quantile of a group lies between two of its ranks; both groups are asked for as many quantiles as the larger one has values. NULL values are left out.
    """
    kept = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.lit(1).alias("one"))
    placed = cut(running(kept, ["g"], ["v"], {"upto": "one"}).select("g", "v", (F.col("upto") - 1).alias("i")))
    size = lambda name: F.coalesce(F.sum((F.col("g") == name).cast("long")), F.lit(0))
    sizes = kept.agg(size(first).alias("n1"), size(second).alias("n2"))
    sizes = sizes.select(F.when(F.col("n1") >= F.col("n2"), first).otherwise(second).alias("large"), F.greatest("n1", "n2").alias("m"), F.least("n1", "n2").alias("least"))
    grid = placed.crossJoin(F.broadcast(sizes)).where("g = large").select("i", "m", "least", F.explode(F.array(F.struct(F.col("g").alias("g"), F.col("m").alias("n"), F.lit(1).alias("sign")), F.struct(F.when(F.col("g") == first, second).otherwise(first).alias("g"), F.col("least").alias("n"), F.lit(-1).alias("sign")))).alias("s"))  # one row
    place = F.when(F.col("least") == 0, F.col("i").cast("double")).otherwise((F.col("i") + 0.5) / F.col("m") * (F.col("s.n") - 1))
    grid = grid.select("i", F.col("s.g").alias("g"), F.col("s.sign").alias("sign"), F.col("s.n").alias("n"), place.alias("place")).where("n > 0")
    grid = grid.withColumn("low", F.floor("place")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    at = lambda name, v: placed.select("g", F.col("i").alias(name), F.col("v").alias(v))
    found = grid.join(at("low", "y"), ["g", "low"]).join(at("high", "z"), ["g", "high"])
    gaps = found.groupBy("i").agg(F.abs(F.sum(F.col("sign") * (F.col("y") + (F.col("place") - F.col("low")) * (F.col("z") - F.col("y"))))).alias("gap"))
    return gaps.agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("distance"))


def certainty(passes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long predictions (sample_id, label, pass, class, prob) -> sample_id, label, pred, wd.

    pred is the class with the largest mean; wd the smallest distance between its probabilities over the passes and another class's; 0 with a single class.
    """
    keys = keys or ["sample_id", "label"]
    by_class = passes.groupBy(*keys, "class").agg(F.avg("prob").alias("mean"), F.collect_list("prob").alias("p"))
    every = by_class.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("class", "mean", "p"))).alias("c"))
    best = F.reduce("c", F.get("c", F.lit(0)), lambda s, x: F.when(x["mean"] > s["mean"], x).otherwise(s))
    rows = every.withColumn("best", best)
    others = F.transform(F.filter("c", lambda x: x["class"] != F.col("best.class")), lambda x: wasserstein_equal(F.col("best.p"), x["p"]))
    return rows.select(*keys, F.col("best.class").alias("pred"), F.coalesce(F.array_min(others), F.lit(0.0)).alias("wd"))


def sweep(rows: DataFrame, value: str, top: Column | float | None, steps: int = 50, classes: int = 2, absent: str = "skip", inclusive: bool = False) -> DataFrame:
    """threshold_no, threshold, kept, kept_share, accuracy, balanced_accuracy of the rows whose value is above each threshold.

    Thresholds are steps equal steps from 0 to top (the largest value if None). NULL measures where nothing is kept.
    """
    keys = F.col(value)
    limit = rows.agg(F.max(value).alias("top")) if top is None else rows.sparkSession.range(1).select(F.lit(float(top)).alias("top"))
    grid = limit.select("top", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("threshold_no")).withColumn("threshold", F.col("threshold_no") * F.col("top") / (steps - 1))
    lists = grid.agg(F.array_sort(F.collect_list("threshold")).alias("t"))
    below = F.size(F.filter("t", lambda t: (t <= keys) if inclusive else (t < keys)))
    counted = (
        rows.crossJoin(F.broadcast(lists)).select(below.alias("b"), "label", (F.col("label") == F.col("pred")).cast("long").alias("hit"))
        .groupBy("b", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    )
    labels = counted.select("label").distinct()
    cells = grid.select("threshold_no", "threshold").crossJoin(labels).join(counted.select((F.col("b") - 1).alias("threshold_no"), "label", "n", "hits"), ["threshold_no", "label"], "left")
    up = W.partitionBy("label").orderBy(F.desc("threshold_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cells.withColumn("n", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("hits", F.coalesce(F.sum("hits").over(up), F.lit(0)))
    recall = F.when(F.col("n") > 0, F.col("hits") / F.col("n"))
    n = F.sum("n")
    balanced = F.when(F.count(recall) >= 2, F.avg(recall)) if absent == "skip" else F.when(n > 0, F.coalesce(F.sum(recall), F.lit(0.0)) / classes)
    found = sums.groupBy("threshold_no", "threshold").agg(n.alias("kept"), F.when(n > 0, F.sum("hits") / n).alias("accuracy"), balanced.alias("balanced_accuracy"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    return found.crossJoin(total).select("threshold_no", "threshold", "kept", (F.col("kept") / F.col("all")).alias("kept_share"), "accuracy", "balanced_accuracy")


def choose(swept: DataFrame, measure: str = "balanced_accuracy", most_removed: float = 0.5) -> DataFrame:
    """One row: threshold, value: the best measure with at most so large a share removed, the first of equals; 0 where none is valid."""
    ok = swept.where((1 - F.col("kept_share") <= most_removed) & F.col(measure).isNotNull())
    best = ok.agg(F.max_by(F.struct("threshold", F.col(measure).alias("value")), F.struct(F.col(measure), (-F.col("threshold_no")).alias("t"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.0)).alias("threshold"), F.col("b.value").alias("value"))


def binary_sweep(rows: DataFrame, steps: int = 101) -> DataFrame:
    """score, label (0/1) -> threshold_no, threshold and all binary scores when score >= threshold means 1; thresholds from 0 to 1."""
    grid = rows.sparkSession.range(steps).select(F.col("id").cast("int").alias("threshold_no"), (F.col("id") / (steps - 1)).alias("threshold"))
    lists = grid.agg(F.array_sort(F.collect_list("threshold")).alias("t"))
    counted = rows.crossJoin(F.broadcast(lists)).select((F.size(F.filter("t", lambda t: t <= F.col("score"))) - 1).alias("threshold_no"), "label").groupBy("threshold_no").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("c"))
    cells = grid.join(counted, "threshold_no", "left").fillna(0, ["p", "c"])
    up = W.orderBy(F.desc("threshold_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = rows.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("all"))
    sums = cells.select("threshold_no", "threshold", F.sum("p").over(up).alias("tp"), F.sum(F.col("c") - F.col("p")).over(up).alias("fp")).crossJoin(every)
    scores = metrics.binary_scores(F.col("tp"), F.col("fp"), F.col("all") - F.col("pos") - F.col("fp"), F.col("pos") - F.col("tp"))
    return sums.select("threshold_no", "threshold", *[v.alias(k) for k, v in scores.items()])


def best_binary_threshold(rows: DataFrame, metric: str = "mcc", steps: int = 101) -> DataFrame:
    """One row: threshold, value: the first of the best."""
    best = F.max_by(F.struct("threshold", F.col(metric).alias("value")), F.struct(F.round(F.col(metric), 12), (-F.col("threshold_no")).alias("t")))
    return binary_sweep(rows, steps).agg(best.alias("b")).select("b.threshold", "b.value")


def best_class_thresholds(rows: DataFrame, steps: int = 101) -> DataFrame:
    """label, probs -> class, threshold, value: one-versus-rest thresholds by MCC for every class, in one pass."""
    each = rows.select("label", F.posexplode("probs").alias("class", "score")).select("class", "score", (F.col("label") == F.col("class")).cast("int").alias("label"))
    number = F.least(F.lit(steps - 1), F.floor(F.col("score") * (steps - 1) + 1e-12)).cast("int")
    counted = each.groupBy("class", number.alias("threshold_no")).agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("c"))
    grid = each.select("class").distinct().crossJoin(rows.sparkSession.range(steps).select(F.col("id").cast("int").alias("threshold_no")))
    cells = grid.join(counted, ["class", "threshold_no"], "left").fillna(0, ["p", "c"])
    up = W.partitionBy("class").orderBy(F.desc("threshold_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("class")
    sums = cells.select("class", "threshold_no", F.sum("p").over(up).alias("tp"), F.sum(F.col("c") - F.col("p")).over(up).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("c").over(every).alias("all"))
    mcc = metrics.binary_scores(F.col("tp"), F.col("fp"), F.col("all") - F.col("pos") - F.col("fp"), F.col("pos") - F.col("tp"))["mcc"]
    best = sums.withColumn("mcc", mcc).groupBy("class").agg(F.max_by(F.struct("threshold_no", "mcc"), F.struct(F.round("mcc", 12), (-F.col("threshold_no")).alias("t"))).alias("b"))
    return best.select("class", (F.col("b.threshold_no") / (steps - 1)).alias("threshold"), F.col("b.mcc").alias("value"))


def confidence_sweep(rows: DataFrame, classes: int, steps: int = 51) -> DataFrame:
    """label, probs -> threshold_no, threshold, kept, macro_f1, balanced_accuracy of the rows whose largest probability reaches each threshold.

    Rows are counted once in a cube of (last threshold reached, label, predicted class); sums from the top threshold down give all of them in one pass.
    macro_f1 is over all classes, balanced_accuracy over those with rows; both are 0 where nothing is kept.
    """
    spark = rows.sparkSession
    ticks = F.array(*[F.lit(i * (1.0 / (steps - 1))) for i in range(steps)])
    reached = F.size(F.filter(ticks, lambda t: t <= F.array_max("probs"))) - 1
    cube = rows.select(reached.alias("threshold_no"), F.col("label").cast("int").alias("label"), arrays.argmax(F.col("probs")).alias("pred")).groupBy("threshold_no", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    cells = each(steps, "threshold_no").crossJoin(each(classes, "label")).crossJoin(each(classes, "pred")).join(cube, ["threshold_no", "label", "pred"], "left")
    up = W.partitionBy("label", "pred").orderBy(F.desc("threshold_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cells.select("threshold_no", "label", "pred", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n"))
    sides = sums.select("threshold_no", "n", (F.col("label") == F.col("pred")).alias("hit"), F.posexplode(F.array("label", "pred")).alias("side", "class"))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    rates = sides.groupBy("threshold_no", "class").agg(of(F.col("hit") & (F.col("side") == 0)).alias("tp"), of(F.col("side") == 0).alias("support"), F.sum("n").alias("both"))
    f1 = F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(0.0)
    found = rates.groupBy("threshold_no").agg(F.sum("support").alias("kept"), F.avg(f1).alias("macro_f1"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))), F.lit(0.0)).alias("balanced_accuracy"))
    return found.select("threshold_no", (F.col("threshold_no") * F.lit(1.0 / (steps - 1))).alias("threshold"), "kept", "macro_f1", "balanced_accuracy")


def best_confidence_threshold(rows: DataFrame, classes: int, metric: str = "macro_f1", steps: int = 51) -> DataFrame:
    """One row: threshold, value: the one confidence threshold with the best metric, the first of equals."""
    best = F.max_by(F.struct("threshold", F.col(metric).alias("value")), F.struct(F.round(F.col(metric), 12), (-F.col("threshold_no")).alias("t")))
    return confidence_sweep(rows, classes, steps).agg(best.alias("b")).select("b.threshold", "b.value")


def apply_threshold(probs: Column, threshold: float | list[float], classes: int, uncertain_argmax: bool = False) -> Column:
    """Class number: binary by probability of class 1; else the argmax if it reaches its threshold, otherwise -1 (or the argmax all the same)."""
    from ..functions.arrays import argmax

    if classes == 2 and not isinstance(threshold, list):
        return (F.get(probs, F.lit(1)) >= F.lit(float(threshold))).cast("int")
    limits = F.array(*[F.lit(float(t)) for t in (threshold if isinstance(threshold, list) else [threshold] * classes)])
    best = argmax(probs)
    return F.when(F.get(probs, best) >= F.get(limits, best), best).otherwise(best if uncertain_argmax else F.lit(-1))


def margin(probs: Column) -> Column:
    return F.abs(F.get(probs, F.lit(0)) - F.get(probs, F.lit(1)))
