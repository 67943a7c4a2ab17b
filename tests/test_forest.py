"""Forests that grow in tasks, against trees grown plainly."""

import numpy as np
import pytest

from tracework.operators import forest, learn, lockstep, metrics


def plain_tree(rows, classes, depth):
    """Nested (bin, left, right) or shares of weighted (bin, label, weight) rows of one feature; the first of the best splits counts."""
    counts = np.zeros(classes)
    for _, label, weight in rows:
        counts[label] += weight
    score = lambda part: sum(sum(w for _, y, w in part if y == c) ** 2 for c in range(classes)) / sum(w for *_, w in part)
    best, at = score(rows) * (1 + 1e-12), None
    for b in sorted({r[0] for r in rows})[:-1]:
        now = score([r for r in rows if r[0] <= b]) + score([r for r in rows if r[0] > b])
        if now > best and depth and counts.max() < counts.sum():
            best, at = now, b
    if at is None:
        return tuple(counts / counts.sum())
    return at, plain_tree([r for r in rows if r[0] <= at], classes, depth - 1), plain_tree([r for r in rows if r[0] > at], classes, depth - 1)


def nested(feature, cut, shares, at=0):
    """The same form of a grown tree."""
    inner, leaf = np.cumsum(feature >= 0), np.cumsum(feature < 0)
    if feature[at] < 0:
        return tuple(shares[leaf[at] - 1])
    return int(cut[at]), nested(feature, cut, shares, 2 * inner[at] - 1), nested(feature, cut, shares, 2 * inner[at])


@pytest.mark.parametrize(("classes", "depth"), [(2, 30), (3, 30), (3, 2), (1, 30)])
def test_trees_equal_plain_ones(classes, depth):
    rng = np.random.default_rng(classes + depth)
    x, label, key = rng.integers(0, 12, (60, 1)).astype(np.uint8), rng.integers(0, classes, 60), rng.integers(-(2**62), 2**62, 60)
    kind = forest.Forest(5, 3, depth)
    for tree, feature, cut, shares, _ in forest.grown_trees(kind, [0, 2, 4], x, label, key, classes):
        times = forest._drawn(kind, tree, key)
        want = plain_tree([(int(b), int(y), int(w)) for b, y, w in zip(x[:, 0], label, times, strict=True) if w], classes, depth)
        assert nested(feature, cut, shares) == pytest.approx(want) if isinstance(want[-1], float) else repr(nested(feature, cut, shares)) == repr(want)
    assert abs(forest._drawn(kind, 1, rng.integers(0, 2**62, 20_000)).mean() - 1) < 0.03


def features(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, *[float(v) for v in rng.normal(i % 2, 1.0, 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "trace_id long, class_idx int, a double, b double, c double")


def test_forests_do_not_depend_on_partitions(spark):
    """Nor on how many trees grow at once; nodes stay in the shared folder."""
    df, names = features(spark), ("a", "b", "c")
    one, other = (learn.forest(30).fit(learn.assembled(df.repartition(n), names, "class_idx")) for n in (1, 7))
    want, got = ({r.trace_id: r.probs for r in learn.score(m, df, names, "class_idx").collect()} for m in (one, other))
    assert want == got and len(want) == 400
    assert spark.read.parquet(one.path).count() == 30
    assert np.allclose(one.importances(spark), other.importances(spark)) and np.isclose(one.importances(spark).sum(), 1)
    assert metrics.accuracy(learn.score(one, df, names, "class_idx")).first()[0] > 0.95


def test_rows_are_made_once(spark):
    """Rankings read a forest's rows several times; what they come from, dwell features of all frames say, is computed once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = features(spark).mapInArrow(count, "trace_id long, class_idx int, a double, b double, c double")
    learn.scrambled_control(df, ("a", "b", "c"), "class_idx", "trace_id", learn.forest(5)).count()
    assert seen.value == 400


def test_equal_and_infinite_features(spark):
    rows = [(i, int(i >= 10), v, 1.0) for i, v in enumerate([float("-inf")] * 5 + [0.0] * 5 + [1.0] * 5 + [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "trace_id long, class_idx int, a double, b double")
    found = learn.score(learn.forest(9).setBootstrap(False).fit(learn.assembled(df, ("a", "b"), "class_idx")), df, ("a", "b"), "class_idx").collect()
    assert len(found) == 20 and all(r.pred == r.class_idx and r.probs == [1.0 - r.pred, r.pred] for r in found)
    with pytest.raises(ValueError, match="rows"):
        learn.forest(3).fit(learn.assembled(df.where("false"), ("a",), "class_idx"))


def test_scores_of_folds_are_written_once(spark):
    """Metrics read them several times."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in rng.normal(i % 2, 1, 12)]) for i in range(40)], "trace_id long, class_idx int, values array<double>")
    found = learn.cross_validate(df, 2, [0], ["forest", "logistic"], 2, trees=3)
    assert "MapInArrow" not in found._jdf.queryExecution().toString() and found.count() == 80


def test_steps_read_packed_rows(spark):
    """A fit makes its rows once, whatever the number of its steps."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i % 2, [float(v) for v in rng.normal(i % 2, 1, 2)]) for i in range(60)], "label int, x array<double>")
    counted = rows.mapInArrow(count, "label int, x array<double>")
    every = lambda k, c: np.ones(len(c["label"]), bool)
    scaled = lockstep.scales(rows, ["one"], every, 2)
    weights = lockstep.fit(counted, ["one"], every, lockstep.Logistic(2, 2), scaled, 5)
    assert seen.value == 60 and np.isfinite(weights["one"]).all()
