"""Trace operators against brute force, and properties that must hold for any data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracework.functions import arrays
from tracework.operators import augment, certainty, dwell, gates, learn, metrics, mixture, normalize, parameters, sampling, spatial, stats
from tracework.sources import catalog, sinks


def traces_of(spark, arrays_, **more):
    return spark.createDataFrame([(i, i % 2, list(map(float, v))) for i, v in enumerate(arrays_)], "trace_id long, class_idx long, values array<double>")


def values(df, column="values"):
    return {r.trace_id: r[column] for r in df.collect()}


def two_level(seed, n=400, levels=(2.0, 12.0)):
    """A trace with known ON stretches."""
    rng = random.Random(seed)
    out, on = [], []
    while len(out) < n:
        for state, mean in ((0, 12), (1, 6)):
            k = 1 + int(rng.expovariate(1 / mean))
            out += [rng.gauss(levels[state], 1.0) for _ in range(k)]
            on += [bool(state)] * k
    return out[:n], on[:n]


def runs_of(on, width=1):
    out, start = [], None
    for i, x in enumerate([*on, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            if i - start >= width:
                out.append((start, i - 1))
            start = None
    return out


def test_array_statistics(spark):
    rng = np.random.default_rng(0)
    data = [rng.normal(size=n) for n in (1, 2, 3, 10, 101)] + [np.full(4, 3.0)]
    v = F.col("values")
    rows = traces_of(spark, data).select("trace_id", arrays.mean(v).alias("mean"), arrays.std(v).alias("p"), arrays.std(v, 1).alias("s"), arrays.median(v).alias("m"), normalize.zscore(v).alias("z"), normalize.minmax(v).alias("mm"), gates.robust_score(v).alias("r")).collect()
    for r in rows:
        x = data[r.trace_id]
        assert np.isclose(r.mean, x.mean()) and np.isclose(r.p, x.std()) and np.isclose(r.m, np.median(x))
        assert r.s is None if len(x) == 1 else np.isclose(r.s, x.std(ddof=1))
        assert np.allclose(r.z, (x - x.mean()) / (x.std() or 1)) and np.allclose(r.mm, (x - x.min()) / (np.ptp(x) or 1))
        mad = max(np.median(np.abs(x - np.median(x))), 1e-10)
        assert np.isclose(r.r, (x.max() - np.median(x)) / mad)


def test_invalid_and_short_traces_go(spark):
    nan, inf = float("nan"), float("inf")
    df = traces_of(spark, [[1, 2, 3], [1, 0, 3], [1, nan, 3], [1, 2], [1, 2, 3, 4]])
    assert values(normalize.fixed(df, 3)) == {0: [1, 2, 3], 4: [1, 2, 3]}
    clean = values(traces_of(spark, [[nan, inf, -inf, 2]]).withColumn("values", normalize.sanitize(F.col("values"))))
    assert clean == {0: [0, 1e6, -1e6, 2]}
    with pytest.raises(Exception, match="trim"):
        traces_of(spark, [[1.0, 2.0]]).select(normalize.trim_tail(F.col("values"), 2)).collect()


def test_runs_features_and_array_form(spark):
    rng = random.Random(1)
    masks = [[rng.random() < 0.5 for _ in range(60)] for _ in range(20)] + [[False] * 9, [True] * 9]
    df = spark.createDataFrame([(i, [1.0 + x for x in m], m) for i, m in enumerate(masks)], "trace_id long, values array<double>, on array<boolean>")
    frames = df.select("trace_id", F.posexplode("on").alias("frame", "on"), F.lit(1.0).alias("intensity"))
    for width in (1, 3):
        found = {}
        for r in dwell.runs(frames, width).orderBy("trace_id", "run").collect():
            found.setdefault(r.trace_id, []).append((r.start, r.end))
        folded = {r.trace_id: [(x.start, x.end) for x in r.r] for r in df.select("trace_id", dwell.array_runs(F.col("on"), width).alias("r")).collect()}
        for i, m in enumerate(masks):
            assert found.get(i, []) == runs_of(m, width) == folded[i]
    for r in dwell.features(frames, 2).collect():
        runs = runs_of(masks[r.trace_id], 2)
        assert r.n_runs == len(runs)
        if runs:
            assert np.isclose(r.duty_cycle, sum(masks[r.trace_id]) / (runs[-1][1] - runs[0][0] + 1))
            offs = [b[0] - a[1] - 1 for a, b in itertools.pairwise(runs)]
            assert r.mean_off is None if not offs else np.isclose(r.mean_off, np.mean(offs))
        else:
            assert r.duty_cycle is None and r.mean_on is None


def test_mixture_finds_planted_levels(spark):
    planted = [two_level(s) for s in range(8)]
    df = mixture.with_mixture(traces_of(spark, [p[0] for p in planted] + [[5.0] * 30, [float("nan")] * 30]))
    m = F.col("mixture")
    for r in df.select("trace_id", "mixture", mixture.separation(m).alias("sep"), mixture.on_mask(F.col("values"), m, 0.5, 3.0).alias("on")).collect():
        if r.trace_id < 8:
            assert abs(r.mixture.mean0 - 2) < 0.5 and abs(r.mixture.mean1 - 12) < 0.5 and r.sep > 5
            assert np.mean(np.array(r.on) == np.array(planted[r.trace_id][1])) > 0.99
        else:
            assert r.mixture.mean0 is None and r.sep == 0 and not any(r.on)


def test_best_split_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = np.sort(rng.normal(size=12).round(1))
        if x[0] == x[-1]:
            continue
        cost = {k: x[:k].var() * k + x[k:].var() * (len(x) - k) for k in range(1, len(x)) if x[k] != x[k - 1]}
        assert np.isclose(cost[int(mixture.best_splits(x[None])[0])], min(cost.values()))



def test_painter_against_a_pixel_loop(spark):
    rng = random.Random(3)
    rois = [(m, i, rng.randint(-2, 34), rng.randint(-2, 34)) for m in range(3) for i in range(25)]
    df = spark.createDataFrame(rois, "movie_id long, roi int, x int, y int")
    expected = set()
    for m in range(3):
        canvas = np.full((38, 38), -1)
        for _, i, x, y in [r for r in rois if r[0] == m]:
            if x >= 0 and y >= 0:
                seen, n = np.unique(canvas[y : y + 7, x : x + 7], return_counts=True)
                hidden = {int(s): int(c) for s, c in zip(seen, n, strict=True) if s >= 0}
                if hidden and max(hidden) > 0:
                    for j, c in hidden.items():
                        if c > 3:
                            expected |= {(m, i), (m, j)}
                canvas[y : y + 7, x : x + 7] = i
    assert {(r.movie_id, r.roi) for r in spatial.painter_overlaps(df, 7, 3, 38, 38).collect()} == expected


def test_near_joins_against_all_pairs(spark):
    rng = random.Random(4)
    a = [(m, i, rng.randint(0, 40), rng.randint(0, 40)) for m in range(2) for i in range(60)]
    b = [(m, i, rng.randint(0, 40), rng.randint(0, 40)) for m in range(2) for i in range(20)]
    left, right = (spark.createDataFrame(x, "movie_id long, roi int, x int, y int") for x in (a, b))
    near = {(m, i): min(np.hypot(x - u, y - v) for n, _, u, v in b if n == m) for m, i, x, y in a}
    for r in spatial.label_by_nearest(left, right, 4.0).collect():
        assert (r.ground_truth == "IN") == (near[r.movie_id, r.roi] < 4)
    assert {(r.movie_id, r.roi) for r in spatial.background_buffer(left, right, 5.0).collect()} == {k for k, d in near.items() if d > 5}
    assert spatial.background_buffer(left, right, 0).count() == len(a)
    assert {r.ground_truth for r in spatial.label_by_nearest(left, right.where("false"), 4.0).collect()} == {"OUT"}


def test_roi_traces_fill_missing_frames(spark):
    pixels = spark.createDataFrame([(1, f, y, x, 1 + f) for f in (1, 3, 4) for y in range(4) for x in range(4)] + [(1, 6, 30, 30, 5)], "movie_id long, frame int, y int, x int, intensity long")
    rois = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 2, 2), (1, 2, 20, 20)], "movie_id long, roi int, x int, y int")
    rows = {r.roi: r for r in spatial.roi_traces(pixels, rois, rois.where("roi = 1").select("movie_id", "roi"), 2, 40, 40).collect()}
    assert rows[0].values == [0, 8, 0, 16, 20, 0, 0] and rows[1].values == [] and rows[1].overlap == "overlapping" and rows[2].values == [0.0] * 7


def test_links_and_clusters(spark):
    rng = random.Random(5)
    locs = [(i, i % 2, rng.randint(0, 30), rng.uniform(0, 25), rng.uniform(0, 25)) for i in range(160)]
    df = spark.createDataFrame(locs, "id long, movie_id long, frame int, x double, y double")

    def classes(pairs, ids):
        root = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                low = min(root[a], root[b])
                root[a] = root[b] = low
        return root

    near = [(p[0], q[0]) for p in locs for q in locs if p[0] < q[0] and p[1] == q[1] and np.hypot(p[3] - q[3], p[4] - q[4]) <= 2.0]
    frame = {p[0]: p[2] for p in locs}
    root = classes([(a, b) for a, b in near if 0 < abs(frame[a] - frame[b]) <= 4], frame)
    sizes = {}
    for i in frame:
        sizes[root[i]] = sizes.get(root[i], 0) + 1
    assert {r.molecule: r.n for r in spatial.link_localizations(df, 2.0, 3).collect()} == sizes
    count = {i: 1 + sum(i in p for p in near) for i in frame}
    cores = {i for i in frame if count[i] >= 4}
    root = classes([p for p in near if set(p) <= cores], cores)
    member = {i: root[i] for i in cores}
    for i in set(frame) - cores:
        mine = [root[b if a == i else a] for a, b in near if i in (a, b) and (b if a == i else a) in cores]
        if mine:
            member[i] = min(mine)
    sizes = {}
    for c in member.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r.cluster: r.n for r in spatial.density_clusters(df, 2.0, 4).collect()} == sizes


def test_sweep_against_masks(spark):
    rng = random.Random(6)
    data = [(i, rng.random() < 0.7, rng.random() < 0.6, rng.random()) for i in range(300)]
    df = spark.createDataFrame([(i, int(y), int(p), w) for i, y, p, w in data], "sample_id long, label int, pred int, wd double")
    top = max(d[3] for d in data)
    for r in certainty.sweep(df, "wd", None, 20).collect():
        t = r.threshold_no * top / 19
        kept = [d for d in data if d[3] > t]
        assert r.kept == len(kept)
        if kept:
            assert np.isclose(r.accuracy, np.mean([y == p for _, y, p, _ in kept]))
            recalls = [np.mean([y == p for _, y, p, _ in kept if y == c]) for c in {d[1] for d in kept}]
            assert (r.balanced_accuracy is None) if len(recalls) < 2 else np.isclose(r.balanced_accuracy, np.mean(recalls))
        else:
            assert r.accuracy is None
    assert certainty.choose(certainty.sweep(df, "wd", None, 20), most_removed=-1.0).first().threshold == 0.0


def test_metrics_of_missing_classes(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 1, [0.4, 0.6])], "label int, pred int, probs array<double>")
    assert metrics.auc(df.withColumn("score", F.col("probs")[1])).first().auc is None
    assert metrics.balanced_accuracy(df, 2).first()[0] is None and metrics.balanced_accuracy(df, 2, "zero").first()[0] == 0.25
    assert [(r.label, r.pred, r.n) for r in metrics.confusion(df, 2).orderBy("label", "pred").collect()] == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]


def test_splits_folds_and_scrambles(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aab")) for i in range(500)]
    one, many = (spark.createDataFrame(rows, "id long, label string").repartition(n) for n in (1, 7))
    for f in (lambda d: sampling.stratified_split(d, "label", "id", {"x": 0.7, "y": 0.15, "z": 0.15}), lambda d: sampling.stratified_folds(d, "label", "id", 5), lambda d: sampling.scramble(d, "label", "id"), lambda d: sampling.resample(d, "label", "id", 200), lambda d: sampling.balance(d, "label", "id")):
        a, b = sorted(map(tuple, f(one).collect())), sorted(map(tuple, f(many).collect()))
        assert a == b and len(a) > 0
    folds = sampling.stratified_folds(many, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in "ab":
        n = [r["count"] for r in folds if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
    mixed = sampling.scramble(many, "label", "id").collect()
    assert sorted(r.scrambled for r in mixed) == sorted(r.label for r in mixed) and any(r.scrambled != r.label for r in mixed)
    counts = {r.label: r["count"] for r in sampling.balance(many, "label", "id").groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    drawn = [r.label for r in sampling.resample(many, "label", "id", 2000).collect()]
    assert abs(drawn.count("a") / 2000 - 0.5) < 0.05


def test_augmentation_stays_out_of_validation(spark):
    rng = np.random.default_rng(8)
    df = sampling.stratified_folds(traces_of(spark, rng.normal(5, 1, (40, 30))), "class_idx", "trace_id", 4)
    rows = augment.training_rows(df, 2, 3, mirrored=True, on=F.transform("values", lambda v: v > 5)).collect()
    assert all(r.fold != 2 for r in rows) and len(rows) == 4 * df.where("fold <> 2").count()
    plain = {r.trace_id: np.array(r["values"]) for r in rows if r.copy == 0}
    for r in rows:
        if r.copy > 0:
            x = np.array(r["values"])
            assert len(x) == 30 and 0 < np.abs(x - plain[r.trace_id]).mean() < 1
    twice = F.transform("values", lambda v: v > 5)
    back = df.withColumn("on", twice).withColumn("m", augment.mirror(F.col("values"), F.col("on"))).withColumn("back", augment.mirror(F.col("m"), F.transform("m", lambda v: v > 5)))
    assert all(r.back == r["values"] for r in back.collect())


def test_rank_test_and_adjustment(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 20, 60).astype(float), rng.integers(5, 25, 50).astype(float)
    df = spark.createDataFrame([("a", x) for x in a.tolist()] + [("b", x) for x in b.tolist()] + [("a", float("nan"))], "g string, value double")
    r = stats.mann_whitney(df, "g", "a").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    _, ties = np.unique(np.concatenate([a, b]), return_counts=True)
    z = (abs(u - 1500) - 0.5) / math.sqrt(3000 / 12 * (111 - (ties**3 - ties).sum() / (110 * 109)))
    assert r.u == u and np.isclose(r.r, 1 - 2 * u / 3000) and np.isclose(r.p, math.erfc(z / math.sqrt(2)))
    assert stats.mann_whitney(df.where("g = 'a'"), "g", "a").first().p is None
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = {round(r.p, 2): round(r.p_adjusted, 4) for r in stats.benjamini_hochberg(tests).collect()}
    assert got == {0.01: 0.04, 0.03: 0.0533, 0.04: 0.0533, 0.5: 0.5}


def test_wasserstein(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=8).tolist(), rng.normal(1, 1, 8).tolist()
    df = spark.createDataFrame([(a, b, [])], "a array<double>, b array<double>, e array<double>")
    same, mid, empty = df.select(certainty.wasserstein_equal(F.col("a"), F.col("b")), certainty.wasserstein(F.col("a"), F.col("b")), certainty.wasserstein(F.col("a"), F.col("e"))).first()
    expected = np.abs(np.sort(a) - np.sort(b)).mean()
    q = (np.arange(8) + 0.5) / 8
    assert np.isclose(same, expected) and np.isclose(mid, np.abs(np.quantile(a, q) - np.quantile(b, q)).mean()) and np.isclose(empty, np.abs(a).mean())


def test_ordered_over_several_ranges(spark):
    rng = np.random.default_rng(12)
    label, score = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(i), int(y), float(s), "ab"[y]) for i, (y, s) in enumerate(zip(label, score, strict=True))], "id int, label int, score double, g string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = {r.score: (r.tp, r.fp, r.pos, r.neg) for r in metrics.curve(df).collect()}
        assert points == {s: (int(label[score >= s].sum()), int((1 - label[score >= s]).sum()), int(label.sum()), int((1 - label).sum())) for s in set(score.tolist())}
        one, none = score[label == 1][:, None], score[label == 0][None]
        assert np.isclose(metrics.auc(df).first().auc, ((one > none) + 0.5 * (one == none)).mean())
        recall, precision, area = 0.0, 1.0, 0.0
        for s in sorted(points, reverse=True):
            r, p = points[s][0] / points[s][2], points[s][0] / (points[s][0] + points[s][1])
            area, recall, precision = area + (r - recall) * (p + precision) / 2, r, p
        assert np.isclose(metrics.pr_auc(df).first().pr_auc, area)
        assert metrics.pr_auc(df.where("label = 0")).first().pr_auc is None
        numbers = {r.id: r.n for r in sampling.numbered(df, "g", ["score", "id"], "n").collect()}
        for y in (0, 1):
            ids = sorted((float(score[i]), i) for i in range(400) if label[i] == y)
            assert [numbers[i] for _, i in ids] == list(range(len(ids)))
        values = lambda y: [float(v) for v in score[label == y]]
        lists = spark.createDataFrame([(values(0), values(1)[:37], [])], "a array<double>, b array<double>, e array<double>")
        cut_off = df.where(f"label = 0 or id <= {[i for i in range(400) if label[i] == 1][36]}")
        want = lists.select(certainty.wasserstein(F.col("a"), F.col("b")), certainty.wasserstein(F.col("a"), F.col("e"))).first()
        assert np.isclose(certainty.wasserstein_rows(cut_off, "g", "b", "a", "score").first()[0], want[0])
        assert np.isclose(certainty.wasserstein_rows(df.where("label = 0"), "g", "b", "a", "score").first()[0], want[1])
        assert certainty.wasserstein_rows(df.limit(0), "g", "a", "b", "score").first()[0] == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_early_stop(spark):
    history = [(1, e, auc, 1.0) for e, auc in enumerate([0.5, 0.6, 0.6, 0.6, 0.7], 1)]
    df = spark.createDataFrame(history, "run int, epoch int, val_auc double, val_loss double")
    assert tuple(learn.early_stop(df, patience=2).first())[1:] == (2, 0.6, 4)
    assert tuple(learn.early_stop(df, patience=3).first())[1:] == (5, 0.7, None)


def plain_early_stop(history, delta, tol, loss_delta, patience, limit, mode, alternative):
    best_auc, low, taken, best, waited = -np.inf, np.inf, np.inf, 0, 0
    for epoch, auc, loss in history:
        low = min(low, loss)
        fine = loss <= low * limit if mode == "relative" else loss <= low + limit if mode == "absolute" else True
        primary = np.isfinite(auc) and auc >= best_auc + delta and fine
        other = alternative and np.isfinite(auc) and best_auc > -np.inf and auc >= best_auc - tol and loss <= taken - loss_delta
        if primary or other:
            best_auc, taken, best, waited = max(best_auc, auc), loss, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return best, best_auc, epoch
    return best, best_auc, None


@pytest.mark.parametrize("mode, limit", [("relative", 1.1), ("absolute", 0.05), ("none", 0.0)])
@pytest.mark.parametrize("alternative", [True, False])
def test_early_stop_is_a_plain_loop(spark, mode, limit, alternative):
    rng = np.random.default_rng(12)
    runs = {r: [(e, float("nan") if rng.random() < 0.05 else round(0.5 + 0.02 * e**0.5 + 0.01 * rng.standard_normal(), 4), round(1 / e**0.3 + 0.08 * rng.standard_normal(), 4)) for e in range(1, 40)] for r in range(60)}
    df = spark.createDataFrame([(r, *x) for r, h in runs.items() for x in h], "run int, epoch int, val_auc double, val_loss double")
    options = dict(delta=0.005, tol=0.003, loss_delta=0.005, patience=4)
    found = {r.run: (r.best_epoch, r.best_auc, r.stop_epoch) for r in learn.early_stop(df, loss_limit=limit, loss_mode=mode, alternative=alternative, **options).collect()}
    assert found == {r: plain_early_stop(h, *options.values(), limit, mode, alternative) for r, h in runs.items()}


def test_datasets_and_filters_are_chosen_or_refused(spark):
    one, two = spark.range(1), spark.range(2)
    assert catalog.choose_dataset({"a": one, "b": two}, "b") is two and catalog.choose_dataset(None, None, one) is one
    for tables, use, single in (({"a": one}, "c", two), ({"a": one}, None, None), (None, "a", None)):
        with pytest.raises(KeyError):
            catalog.choose_dataset(tables, use, single)
    movies = spark.createDataFrame([("Exp1", "A"), ("Exp2", "A")], "experiment string, protein string")
    assert catalog.only(movies, "Exp2", "A").count() == 1 and catalog.only(movies).count() == 2
    with pytest.raises(ValueError, match="Exp3"):
        catalog.only(movies, "Exp3")


def test_forest_beats_scrambled_labels(spark):
    rng = np.random.default_rng(11)
    df = traces_of(spark, [rng.normal(i % 2, 1, 40) for i in range(200)])
    rows = learn.trace_features(df)
    real = metrics.accuracy(learn.classify(rows, learn.TRACE_FEATURES, "class_idx", "trace_id", learn.forest(10))[1]).first()[0]
    mixed = metrics.accuracy(learn.scrambled_control(rows, learn.TRACE_FEATURES, "class_idx", "trace_id", learn.forest(10))).first()[0]
    assert real > 0.9 and mixed < 0.8


def test_objective(spark):
    rois = spark.createDataFrame([(1, "single", "IN"), (1, "single", "OUT"), (1, "overlapping", "OUT"), (2, "overlapping", "OUT")], "movie_id int, overlap string, ground_truth string")
    rows = {r.movie_id: r.objective for r in parameters.movie_objective(rois, ["movie_id"]).collect()}
    assert np.isclose(rows[1], 2 * 1.5 * (2 / 3) ** 2) and rows[2] == 0


def test_catalog_and_pairs(spark):
    paths = ["Exp1/P/P_640nm_a_0001.nd2", "Exp1/P/P_488nm_a_0001.nd2", "Exp1/P/P_488nm_b_0001.ND2", "Exp1/P/P_640nm_a_0002.nd2", "Exp1/P/._P_640nm_0003.nd2", ".trash/P/P_640nm_0004.nd2", "Exp1/P/P_640nm_0005.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert catalog.movie_catalog(df).count() == 4
    assert [tuple(r) for r in catalog.pair_channels(df, "640", "488").collect()] == [(paths[0], paths[2])]
    assert catalog.pair_channels(df, "640", None).where("gt_path is null").count() == 5
    found = [r[0] for r in spark.createDataFrame([("a/scGrx1AcK20_1.p",), ("a/scGrx1_1.p",), ("a/x_scGrx1-2.p",)], "path string").where(catalog.compound_match(F.col("path"), "scGrx1")).collect()]
    assert found == ["a/scGrx1_1.p", "a/x_scGrx1-2.p"]


def test_sinks(spark, tmp_path):
    df = traces_of(spark, [[1.0, 2.0], [3.0, 4.0]]).selectExpr("trace_id", "values", "'c' AS compound", "'IN' AS gt_label", "'protein' AS origin", "'raw' AS norm", "'t' AS trace_name")
    path = str(tmp_path / "traces")
    sinks.write_traces(df, path)
    back = spark.read.parquet(path)
    assert catalog.class_slice(back, "c", "raw").count() == 2
    with pytest.raises(ValueError, match="no traces"):
        catalog.class_slice(back, "d", "raw")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    manifest = spark.createDataFrame([("a.bin", "900150983cd24fb0d6963f7d28e17f72"), ("b.bin", "x")], "file string, md5 string")
    assert {r.file: r.ok for r in sinks.checksums(spark, str(tmp_path / "f"), manifest).collect()} == {"a.bin": True, "b.bin": False}
    sinks.write_json(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"), str(tmp_path / "j"))
    assert sorted(str(r.v) for r in spark.read.schema("v double").json(str(tmp_path / "j")).collect()) == ["1.0", "None"]
