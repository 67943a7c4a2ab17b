"""Learning as Spark jobs over trace features, with the controls that go with it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.seeded import uniform
from ..sources.scratch import cut
from . import augment, lockstep, metrics, sampling
from .forest import Forest, Model

TRACE_FEATURES = ("mean", "std", "low", "high", "middle", "roughness")


def trace_features(traces: DataFrame) -> DataFrame:
    """The columns of traces but values, then six numbers that describe each trace."""
    v = F.col("values")
    steps = F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: F.abs(a - b))
    cols = [arrays.mean(v), arrays.std(v), F.array_min(v), F.array_max(v), arrays.median(v), arrays.mean(steps)]
    return traces.select(*[c for c in traces.columns if c != "values"], *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(cols, TRACE_FEATURES, strict=True)])


def forest(trees: int = 500, seed: int = 42, depth: int = 30) -> Forest:
    return Forest(trees, seed, depth)


def assembled(rows: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """rows, then label and features (array); rows with a missing feature are left out."""
    out = rows.withColumn("label", F.col(label).cast("double")).withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))
    return out.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v)))


def score(model: Model, rows: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """The rows, then label, probs, pred (of two classes the second from 0.5 on; else the first of the largest)."""
    ready = cut(assembled(rows, features, label).withColumn("_same", F.xxhash64("features")))  # equal features have equal shares
    out = ready.join(model.probabilities(ready.select("_same", "features"), "_same"), "_same")
    return out.withColumn("pred", predicted(F.col("probs"))).withColumn("label", F.col("label").cast("int")).drop("features", "_same")


def predicted(probs: Column) -> Column:
    return F.when(F.size(probs) == 2, (F.get(probs, F.lit(1)) >= 0.5).cast("int")).otherwise(arrays.argmax(probs))


def split_and_balanced(rows: DataFrame, label: str, id_: str, seed: int = 42) -> DataFrame:
    """rows, then split: an 80/20 stratified split into train and test, of which each part keeps as many rows of a class as of the smallest.

    rows are written first, as every ranking reads them twice.
    """
    split = cut(sampling.stratified_split(cut(rows), label, id_, {"train": 0.8, "test": 0.2}, seed))
    train, test = (sampling.balance(split.where(F.col("split") == part), label, id_, seed) for part in ("train", "test"))
    return train.unionByName(test)


def classify(rows: DataFrame, features: tuple[str, ...], label: str, id_: str, estimator: Forest | None = None, seed: int = 42) -> tuple[Model, DataFrame]:
    """(model, scored test rows): an 80/20 stratified split, then the classes of each part balanced."""
    placed = cut(split_and_balanced(rows, label, id_, seed))
    train, test = placed.where("split = 'train'").drop("split"), placed.where("split = 'test'").drop("split")
    model = (estimator or forest(seed=seed)).fit(assembled(train, features, label))
    return model, score(model, test, features, label)


def importances(spark, model, features: tuple[str, ...]) -> DataFrame:
    """feature, importance, most important first."""
    pairs = [(f, float(v)) for f, v in zip(features, model.importances(spark), strict=True)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def scrambled_control(rows: DataFrame, features: tuple[str, ...], label: str, id_: str, estimator=None, seed: int = 42) -> DataFrame:
    """Scored test rows after the labels were permuted; accuracy is expected at chance."""
    mixed = sampling.scramble(cut(rows), label, id_, seed).drop(label).withColumnRenamed("scrambled", label)
    return classify(mixed, features, label, id_, estimator, seed)[1]


def stochastic_passes(rows: DataFrame, weights: list[list[float]], bias: list[float], n: int, drop: float = 0.2, seed: int = 42, id_: str = "trace_id", x: Column | None = None) -> DataFrame:
    """id, label, pass, class, prob: n passes of a linear softmax scorer with dropped inputs.

    Keep masks come from md5 uniforms of (pass, row, input), kept inputs are scaled by 1 / (1 - drop).
    """
    x = F.col("x") if x is None else x
    passes = rows.select(id_, "label", x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pass"))
    kept = F.transform("x", lambda v, i: F.when(uniform(seed, "mask", F.col("pass"), F.col(id_), i) >= drop, v / (1 - drop)).otherwise(0.0))
    passes = passes.withColumn("x", kept)
    scores = F.array(*[F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(float(b0)), lambda s, v: s + v) for row, b0 in zip(weights, bias, strict=True)])
    return passes.select(id_, "label", "pass", F.posexplode(arrays.softmax(scores)).alias("class", "prob"))


def forest_votes(model: Model, rows: DataFrame, features: tuple[str, ...], label: str, id_: str = "trace_id") -> DataFrame:
    """id, label, pass, class, prob: each tree of a fitted forest of numeric features as a pass of its own, with its leaf's class shares.

    The means over the passes are the forest's probabilities, so its votes go where stochastic passes go. Rows with missing features are left out.
    """
    ready = assembled(rows, features, label).select(id_, F.col("label").cast("int").alias("label"), "features")
    return model.votes(ready, [id_, "label"])


def _fold_member(key, columns):
    """Training rows of a (fold, factor): originals of the other folds, and their copies made for that fold, as many as the factor has."""
    fold, factor = key
    return (columns["fold"] != fold) & ((columns["copy"] == 0) | ((columns["for_fold"] == fold) & (columns["copy"] < factor)))


def fold_table(traces: DataFrame, folds: int, factors: list[int], seed: int = 42) -> DataFrame:
    """trace_id, class_idx, fold, for_fold, copy and the trace features: every trace, and the copies of it that the fits of the other folds learn from. Written once."""
    placed = cut(sampling.stratified_folds(traces, "class_idx", "trace_id", folds, seed))
    out = placed.withColumns({"copy": F.lit(0), "for_fold": F.lit(0)})
    most = max(factors)
    for fold in range(1, folds + 1):
        made = augment.augmented(placed.where(F.col("fold") != fold), most, seed=seed + fold)
        out = out.unionByName(made.withColumn("for_fold", F.lit(fold)).select(*out.columns))
    return cut(trace_features(out))


def cross_validate(traces: DataFrame, folds: int, factors: list[int], names: list[str], classes: int, seed: int = 42, trees: int = 500, at_once: int = 6) -> DataFrame:
    """Scored validation rows of every (model, aug_factor, fold): trace_id, fold, label, pred, probs. Only training rows are augmented.

    Features are made once for all fits. The logistic and perceptron fits of all folds and factors take their steps together, each step one job.
    Forests grow in jobs of their own meanwhile, ``at_once`` of them side by side, each reading its rows from the one table.
    """
    table = fold_table(traces, folds, factors, seed)
    keys = [(fold, factor) for factor in factors for fold in range(1, folds + 1)]
    # a step streams its rows, so a few long tasks cost less than many short ones
    rows = table.coalesce(2 * table.sparkSession.sparkContext.defaultParallelism).select("trace_id", "fold", "for_fold", "copy", F.col("class_idx").cast("int").alias("label"), F.array(*TRACE_FEATURES).alias("x"))
    held = rows.where("copy = 0")
    named = F.broadcast(table.sparkSession.createDataFrame([(i, factor) for i, (_, factor) in enumerate(keys)], "key int, aug_factor int"))  # a row a fit
    parts, scaled = [], None

    def grow(key):
        fold, factor = key
        mine = (F.col("fold") != fold) & ((F.col("copy") == 0) | ((F.col("for_fold") == fold) & (F.col("copy") < factor)))
        return forest(trees, seed).fit(assembled(table.where(mine), TRACE_FEATURES, "class_idx"))

    with ThreadPoolExecutor(at_once) as pool:
        growing = [(key, pool.submit(grow, key)) for key in keys] if "forest" in names else []
        for kind in (lockstep.Logistic, lockstep.Perceptron):
            if kind.name in names:
                model = kind(len(TRACE_FEATURES), classes, seed)
                scaled = scaled or lockstep.scales(rows, keys, _fold_member, len(TRACE_FEATURES))
                weights = lockstep.fit(rows, keys, _fold_member, model, scaled)
                found = lockstep.scored(held, keys, lambda k, c: c["fold"] == k[0], model, scaled, weights, ["trace_id", "fold", "label"])
                parts.append(found.join(named, "key").select("trace_id", "fold", "label", predicted(F.col("probs")).alias("pred"), "probs", F.lit(kind.name).alias("model"), "aug_factor"))
        for (fold, factor), model in growing:
            found = score(model.result(), table.where((F.col("copy") == 0) & (F.col("fold") == fold)), TRACE_FEATURES, "class_idx")
            parts.append(found.select("trace_id", "fold", "label", "pred", "probs", F.lit("forest").alias("model"), F.lit(factor).alias("aug_factor")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut(out)  # metrics read it several times


def fold_metrics(scored: DataFrame, classes: int) -> DataFrame:
    """model, aug_factor, fold, n_val, accuracy, balanced_accuracy, loss: one group-by over all folds."""
    keys = ["model", "aug_factor", "fold"]
    n = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_val"))
    for part in (metrics.accuracy(scored, keys), metrics.balanced_accuracy(scored, classes, "zero", keys), metrics.log_loss(scored, keys)):
        n = n.join(part, keys)
    return n


def early_stop(
    history: DataFrame, delta: float = 0.005, tol: float = 0.003, loss_delta: float = 0.005, patience: int = 10, loss_limit: float = 1.1, loss_mode: str = "relative", alternative: bool = True
) -> DataFrame:
    """run, epoch, val_auc, val_loss -> run, best_epoch, best_auc, stop_epoch (NULL: never stopped).

    An epoch is taken if its AUC is ``delta`` above the best and its loss is not too high: at most ``loss_limit`` times (``relative``)
    or above (``absolute``) the least loss of all epochs so far, itself included; any loss will do in mode ``none``. With ``alternative``
    it is also taken if its AUC is within ``tol`` of the best and its loss ``loss_delta`` below that of the epoch taken last; the best AUC never falls.
    After ``patience`` epochs in a row that aren't taken, training stops. A fold over each run's sorted epochs; an undefined AUC is never taken.
    """
    ordered = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("val_auc").cast("double").alias("auc"), F.col("val_loss").cast("double").alias("loss")))).alias("h"))
    none, much = F.lit(float("-inf")), F.lit(float("inf"))
    zero = F.struct(none.alias("auc"), much.alias("least"), much.alias("taken"), F.lit(0).alias("best"), F.lit(0).alias("waited"), F.lit(0).alias("stop"))

    def step(s, e):
        running = s["stop"] == 0
        least = F.least(s["least"], e["loss"])
        fine = {"relative": e["loss"] <= least * loss_limit, "absolute": e["loss"] <= least + loss_limit, "none": F.lit(True)}[loss_mode]
        known = e["auc"].isNotNull() & ~F.isnan(e["auc"])
        better = (e["auc"] >= s["auc"] + delta) & fine
        lower = F.lit(alternative) & (s["auc"] > none) & (e["auc"] >= s["auc"] - tol) & (e["loss"] <= s["taken"] - loss_delta)
        take = F.coalesce(running & known & (better | lower), F.lit(False))
        waited = F.when(take, 0).otherwise(s["waited"] + 1)
        return F.struct(
            F.when(take, F.greatest(s["auc"], e["auc"])).otherwise(s["auc"]).alias("auc"), least.alias("least"), F.when(take, e["loss"]).otherwise(s["taken"]).alias("taken"),
            F.when(take, e["epoch"]).otherwise(s["best"]).alias("best"), F.when(running, waited).otherwise(s["waited"]).alias("waited"), F.when(running & (waited >= patience), e["epoch"]).otherwise(s["stop"]).alias("stop"),
        )

    out = ordered.withColumn("s", F.aggregate("h", zero, step))
    return out.select("run", F.col("s.best").alias("best_epoch"), F.col("s.auc").alias("best_auc"), F.when(F.col("s.stop") > 0, F.col("s.stop")).alias("stop_epoch"))
