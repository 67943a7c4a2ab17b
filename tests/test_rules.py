"""Rules written out plainly, against the operators that state them as joins, windows and aggregates."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracework.operators import certainty, components, dwell, gates, learn, lockstep, metrics, ordered, parameters, peaks, spatial, stats
from tracework.sources import scratch, sinks


def test_exact_rank_test_equals_enumeration(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key, (m, n) in enumerate(itertools.product(range(2, 9), (2, 3, 5, 8))):
        a, b = (rng.sample(range(1000), m + n)[i : i + m + n] for i in (0, 0))
        a, b = a[:m], a[m:]
        rows += [(key, "a", float(v)) for v in a] + [(key, "b", float(v)) for v in b]
        u = sum(x > y for x in a for y in b)
        every = [sum(c) - m * (m - 1) // 2 for c in itertools.combinations(range(m + n), m)]
        low = min(u, m * n - u)
        want[key] = u, min(1.0, 2 * sum(v <= low for v in every) / len(every))
    found = {r.key: (r.u, r.p) for r in stats.mann_whitney(spark.createDataFrame(rows, "key int, g string, value double"), "g", "a", keys=["key"]).collect()}
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-12 for k in want)


def test_rank_test_of_two_samples_of_four_fully_apart(spark):
    df = spark.createDataFrame([("a" if v < 4 else "b", float(v)) for v in range(8)] + [("a", float("nan")), ("b", None)], "g string, value double")
    assert abs(stats.mann_whitney(df, "g", "a").collect()[0].p - 2 / 70) < 1e-12
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, value double")
    z = (abs(0.5 - 2) - 0.5) / math.sqrt(4 / 12 * (5 - 6 / 12))
    assert abs(stats.mann_whitney(tied, "g", "a").collect()[0].p - math.erfc(z / math.sqrt(2))) < 1e-12
    assert stats.mann_whitney(tied.where("value < 2 or g = 'b'"), "g", "a").collect()[0].p is None


def test_many_values_against_few_are_continuous():
    exact = stats.exact_p(3, 20_000, 9000)
    x = (9000 + 2) / 20_001
    assert abs(exact - 2 * x**3 / 6) < 1e-3 * exact
    assert stats.exact_p(3, 3_000_000, 9_000_000 // 2) == pytest.approx(1.0, abs=1e-6)


@pytest.fixture(scope="module")
def movies():
    rng = random.Random(2)
    masks = {m: np.zeros((31, 37), bool) for m in (1, 2, 3)}
    for m in (1, 2):
        for _ in range(12 * m):
            x, y = rng.randrange(37), rng.randrange(31)
            masks[m][y : y + 4, x : x + 4] = True
    return masks


def free_places(mask, box, edge):
    height, width = mask.shape
    return [(x, y) for y in range(edge, height - box - edge) for x in range(edge, width - box - edge) if not mask[y : y + box, x : x + box].any()]


def test_free_boxes_equal_the_loops(spark, movies):
    taken = spark.createDataFrame([(m, int(x), int(y)) for m, mask in movies.items() for y, x in zip(*np.nonzero(mask))], "movie_id long, x int, y int")
    every = spark.createDataFrame([(m,) for m in movies], "movie_id long")
    found = spatial.free_boxes(taken.unionByName(taken), every, 5, 37, 31, 2).collect()
    assert sorted(map(tuple, found)) == sorted((m, x, y) for m, mask in movies.items() for x, y in free_places(mask, 5, 2))
    coarse = spatial.free_boxes(taken, every, 5, 37, 31, 2, 3).collect()
    assert sorted(map(tuple, coarse)) == sorted((m, x, y) for m, mask in movies.items() for x, y in free_places(mask, 5, 2) if (x - 2) % 3 == 0 and (y - 2) % 3 == 0)
    free = spark.createDataFrame([(9,)], "movie_id long")
    edges = spatial.free_boxes(taken.where("false"), free, 7, 30, 30, 5).agg(F.count("x"), F.max("x"), F.max("y")).collect()[0]
    assert tuple(edges) == (169, 17, 17)


@pytest.mark.parametrize("most", [3, 1000])
def test_sampled_boxes_equal_the_walk(spark, movies, most):
    places = {m: free_places(mask, 4, 1) for m, mask in movies.items()}
    candidates = spark.createDataFrame([(m, x, y) for m, own in places.items() for x, y in own], "movie_id long, x int, y int").repartition(5)
    every = spark.createDataFrame([(m,) for m in movies], "movie_id long")
    want = []
    for m, own in places.items():
        kept = []
        for x, y in sorted(own, key=lambda p: hashlib.md5(f"7:box:{m}:{p[0]}:{p[1]}".encode()).hexdigest()):
            if len(kept) < most and all(abs(x - a) >= 4 or abs(y - b) >= 4 for a, b in kept):
                kept.append((x, y))
        want += [(m, x, y) for x, y in kept]
    assert sorted(map(tuple, spatial.sample_boxes(candidates, every, 4, most, 37, 31, 7).collect())) == sorted(want)
    assert spatial.sample_boxes(candidates.where("false"), every, 4, most, 37, 31, 7).collect() == []


def plain_clusters(points, radius, least):
    xy = np.array([p[2:] for p in points])
    movie = np.array([p[1] for p in points])
    near = (((xy[:, None] - xy[None]) ** 2).sum(2) <= radius * radius) & (movie[:, None] == movie[None])
    core = near.sum(1) >= least
    ids = np.array([p[0] for p in points])
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1), label)
        if (new == label).all():
            break
        label = new
    out = np.where(core, label, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1))
    return {int(c): int((out == c).sum()) for c in set(out.tolist()) if c != np.iinfo(np.int64).max}


@pytest.mark.parametrize("spread", [3.0, 9.0, 25.0])
def test_density_clusters_equal_all_pairs(spark, spread):
    rng = random.Random(int(spread))
    points = [(i * 7 + 1, i % 2, rng.choice([0.0, 0.5, rng.uniform(-spread, spread)]), rng.uniform(-spread, spread)) for i in range(300)]
    points += [(5000 + i, 0, 40.0, 40.0) for i in range(5)] + [(6000, 0, 41.5, 40.0), (6001, 0, 43.0, 40.0)]
    df = spark.createDataFrame(points, "id long, movie_id long, x double, y double")
    assert {r.cluster: r.n for r in spatial.density_clusters(df, 1.5, 4).collect()} == plain_clusters(points, 1.5, 4)


def test_one_hot_cell_and_its_neighbours(spark):
    """10,000 points in one cell, as many in a cell out of reach and in one that a single pair links; no pairs of them are built."""
    side = 1.0 / math.sqrt(2)
    cloud = lambda first, x, y: spark.range(10_000).select((F.col("id") + first).alias("id"), F.lit(1).alias("movie_id"), (x + F.rand(1) * 0.2 * side).alias("x"), (y + F.rand(2) * 0.9 * side).alias("y"))
    bridge = spark.createDataFrame([(90_000, 1, 1.05, 0.3), (90_001, 1, 1.05, 0.31)], "id long, movie_id int, x double, y double")
    rows = cloud(0, 0.0, 0.0).unionByName(cloud(20_000, 1.9, 0.0)).unionByName(cloud(40_000, 9.0, 0.0)).unionByName(bridge)
    found = spatial.density_clusters(rows, 1.0, 3).collect()
    assert sorted((r.cluster, r.n) for r in found) == [(0, 20_002), (40_000, 10_000)]
    assert spatial.density_clusters(rows.where("false"), 1.0, 3).collect() == []


@pytest.mark.parametrize("together", [7, 200_000])
def test_labels_by_tiles_equal_plain_components(spark, monkeypatch, together):
    """A snake through all tiles, separate pairs, repeated and reversed links, a hub, and nodes without a link."""
    monkeypatch.setattr(components, "TOGETHER", together)
    rng = random.Random(together)
    snake = [(i + 1, i) for i in range(0, 400)]
    links = [(i // 20, *p) for i, p in enumerate(snake)] + [(rng.randrange(50), 1000, 1000 + i) for i in range(1, 200)] + [(3, 2000, 2001), (4, 2001, 2000), (5, 2000, 2001)]
    links += [(rng.randrange(20), 3000 + rng.randrange(300), 3000 + rng.randrange(300)) for _ in range(200)]
    nodes = sorted({n for _, *p in links for n in p} | {9000, 9001})
    root = {n: n for n in nodes}
    for _ in nodes:
        before = dict(root)
        for _, a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    rng.shuffle(links)
    found = spatial.tiled_labels(spark.createDataFrame(links, "tile long, a long, b long"), spark.createDataFrame([(n,) for n in nodes], "id long"))
    assert {r.id: r.label for r in found.collect()} == root
    none = spatial.tiled_labels(spark.createDataFrame([], "tile long, a long, b long"), spark.createDataFrame([(5,)], "id long"))
    assert [(r.id, r.label) for r in none.collect()] == [(5, 5)]


def plain_peaks(x, height, width):
    """Peak by peak: flat tops above both neighbours, walks to both sides until something higher, interpolated crossings at half of the prominence."""
    n, found, i = len(x), 0, 1
    while i < n - 1:
        end = i
        while end < n - 1 and x[end + 1] == x[i]:
            end += 1
        if x[i - 1] < x[i] and end < n - 1 and x[end + 1] < x[i]:
            p = (i + end) // 2
            left, low_left, base_left = p, x[p], p
            while left >= 0 and x[left] <= x[p]:
                if x[left] < low_left:
                    low_left, base_left = x[left], left
                left -= 1
            right, low_right, base_right = p, x[p], p
            while right < n and x[right] <= x[p]:
                if x[right] < low_right:
                    low_right, base_right = x[right], right
                right += 1
            level = x[p] - (x[p] - max(low_left, low_right)) / 2
            a = p
            while base_left < a and level < x[a]:
                a -= 1
            b = p
            while b < base_right and level < x[b]:
                b += 1
            a_at = a + (level - x[a]) / (x[a + 1] - x[a]) if x[a] < level else a
            b_at = b - (level - x[b]) / (x[b - 1] - x[b]) if x[b] < level else b
            found += x[p] >= height and b_at - a_at >= width
        i = end + 1
    return found


def test_peaks_of_a_batch_equal_the_walks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    traces = [rng.integers(0, 6, n).astype(float) for n in (1, 2, 3, 5, 60, 61, 200)] + [rng.normal(size=n) for n in (3, 64, 300)] + [np.zeros(0), np.ones(9), np.array([0, 1, 2, 1, 0.0])]
    for width in (0.5, 2.0, 3.0):
        heights = np.array([0.5 * t.std() for t in traces if len(t)] or [0])
        heights = np.array([0.5 * t.std(ddof=1) if len(t) > 1 else np.nan for t in traces])
        assert peaks.counts(traces, heights, width).tolist() == [plain_peaks(t, h, width) for t, h in zip(traces, heights, strict=True)]
    rows = [(i, t.tolist()) for i, t in enumerate(traces)] + [(90, None), (91, [1.0, float("nan"), 0.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, values array<double>")
    for name, rule in (("spread", lambda t: 0.5 * t.std(ddof=1)), ("tail", lambda t: 3 * t[-50:].std(ddof=1))):
        want = {i: int(plain_peaks(t, rule(t), 2.0)) if len(t) > 1 else 0 for i, t in enumerate(traces)} | {90: None, 91: 0}
        assert {r.id: r.n for r in df.select("id", peaks.peak_count(F.col("values"), height=name).alias("n")).collect()} == want


def test_tail_of_a_flat_and_a_short_trace(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0] + [2.0] * 60), (2, [1.0, 2.0, 4.0]), (3, [5.0])], "trace_id int, values array<double>")
    found = {r.trace_id: r for r in gates.tail_statistics(df).collect()}
    assert found[1].snr == 0.0 and found[3].snr == 0.0 and found[3].tail_std is None
    assert found[2].tail_std == pytest.approx(np.std([1, 2, 4], ddof=1)) and found[2].snr == pytest.approx(1.0)


def test_window_of_a_trace_without_a_run(spark):
    frames = spark.createDataFrame([(t, f, float(v), v > 0) for t, row in ((1, [0] * 30), (2, [0] * 20 + [5, 6] + [1] * 8), (3, [0] * 5)) for f, v in enumerate(row)], "trace_id int, frame int, intensity double, on boolean")
    found = dwell.runs(frames, 1, extra=(F.avg("intensity").alias("run_intensity"),))
    lengths = frames.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("length"))
    rows = {r.trace_id: tuple(r)[1:] for r in dwell.highest_run_window(found, lengths, 10).collect()}
    assert rows == {1: (15, 10, 20), 2: (24, 19, 29), 3: (2, 0, 5)}
    assert tuple(dwell.highest_run_window(found, lengths, 7).where("trace_id = 1").collect()[0])[1:] == (15, 12, 19)


def test_reasons_of_few_peaks(spark):
    df = spark.createDataFrame([(1, 0, -1, -1, -1), (2, 1, 5, 5, -1), (3, 2, 5, 90, 85), (4, None, None, None, None)], "id int, n_peaks int, first_peak int, last_peak int, delta_first_second int")
    limits = gates.Gates(min_peaks=0, first_before=4, gap_below=50, last_after=60)
    found = {r.id: list(r.reasons) for r in df.select("id", gates.failures(limits).alias("reasons")).collect()}
    assert found == {
        1: ["n_peaks=0 <= 0", "n_peaks=0", "n_peaks=0 < 2 (cannot check delta)"], 2: ["first_peak=5 >= 4", "n_peaks=1 < 2 (cannot check delta)", "last_peak=5 <= 60"],
        3: ["first_peak=5 >= 4", "delta_1-2=85 >= 50"], 4: ["n_peaks=0 <= 0", "n_peaks=0", "n_peaks=0 < 2 (cannot check delta)"],
    }


def test_diagnosis_below_the_separation_and_of_narrow_runs(spark):
    rng = np.random.default_rng(5)
    low = rng.normal(0, 0.1, 200)
    spikes = low.copy()
    spikes[[20, 60, 61, 62, 100, 101, 102, 103]] += 5.0
    df = spark.createDataFrame([(1, spikes.tolist()), (2, low.tolist())], "trace_id int, values array<double>")
    all_, wide = (({r.trace_id: r for r in gates.diagnose(df, gates.Gates(snr_min=4.0, min_width=w)).collect()}) for w in (1, 2))
    assert (all_[1].n_peaks, wide[1].n_peaks) == (3, 2) and all_[1].first_peak == 20 and wide[1].first_peak in (60, 61, 62)
    assert all_[2].separation < 4 and (all_[2].n_peaks, all_[2].first_peak, all_[2].last_peak, all_[2].delta_first_second) == (0, -1, -1, -1) and "n_peaks=0" in all_[2].reasons


def test_distance_by_linear_quantiles(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 10.0), ("b", 1.0), ("b", 1.0), ("b", 1.0), ("c", 2.0)], "g string, value double")

    def want(x, y):
        m = max(len(x), len(y))
        q = (np.arange(m) + 0.5) / m
        return np.abs(np.quantile(x, q) - np.quantile(y, q)).mean()

    assert certainty.wasserstein_rows(df, "g", "a", "b").first()[0] == pytest.approx(want([0, 0, 10], [1, 1, 1])) == pytest.approx(23 / 9)
    assert certainty.wasserstein_rows(df, "g", "c", "a").first()[0] == pytest.approx(want([2], [0, 0, 10]))
    assert certainty.wasserstein_rows(df, "g", "a", "none").first()[0] == pytest.approx(10 / 3)
    lists = spark.createDataFrame([([0.0, 10.0, 0.0, 3.0], [1.0, 5.0], [])], "a array<double>, b array<double>, e array<double>")
    assert lists.select(certainty.wasserstein(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want([0, 10, 0, 3], [1, 5]))


def test_confidence_thresholds_equal_masks(spark):
    rng = np.random.default_rng(6)
    probs = rng.dirichlet([1, 1, 1], 200)
    label = rng.integers(0, 3, 200)
    df = spark.createDataFrame([(int(y), p.tolist()) for y, p in zip(label, probs, strict=True)], "label int, probs array<double>")
    best = {"macro_f1": (-1, 0), "balanced_accuracy": (-1, 0)}
    rows = {r.threshold_no: r for r in certainty.confidence_sweep(df, 3).collect()}
    for i, t in enumerate(np.linspace(0, 1, 51)):
        keep = probs.max(1) >= t
        y, p = label[keep], probs[keep].argmax(1)
        f1 = [2 * ((y == c) & (p == c)).sum() / max(1, (y == c).sum() + (p == c).sum()) for c in range(3)]
        recall = [((y == c) & (p == c)).sum() / (y == c).sum() for c in range(3) if (y == c).any()]
        want = {"macro_f1": float(np.mean(f1)) if keep.any() else 0.0, "balanced_accuracy": float(np.mean(recall)) if recall else 0.0}
        assert rows[i].kept == keep.sum() and all(rows[i][m] == pytest.approx(v) for m, v in want.items())
        best = {m: max(best[m], (v, -i)) for m, v in want.items()}
    for m, (v, i) in best.items():
        assert tuple(certainty.best_confidence_threshold(df, 3, m).first()) == pytest.approx((-i / 50, v))


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (rng.normal(size=12) + (i % 2) * rng.uniform(0, 1.5)).tolist()) for i in range(120)]
    return learn.fold_table(spark.createDataFrame(rows, "trace_id long, class_idx int, values array<double>"), 3, [0, 3])


def own_rows(table, fold, factor):
    """A fit's training rows by the rule: the other folds' traces and, for factor f, f - 1 copies of each made for this fold."""
    rows = [r for r in table.collect() if r.fold != fold and (r.copy == 0 or (r.for_fold == fold and r.copy < factor))]
    return np.array([[r[f] for f in learn.TRACE_FEATURES] for r in rows]), np.array([r.class_idx for r in rows])


def test_fold_table_has_every_copy_once(folded):
    rows = folded.collect()
    assert len({(r.trace_id, r.for_fold, r.copy) for r in rows}) == len(rows) == 120 + 120 * 2 * 2
    assert all(r.copy == 0 or r.for_fold != r.fold for r in rows)


@pytest.mark.parametrize("kind", [lockstep.Logistic, lockstep.Perceptron])
def test_fits_taken_together_equal_a_fit_alone(folded, kind):
    keys = [(f, a) for a in (0, 3) for f in (1, 2, 3)]
    rows = folded.select("trace_id", "fold", "for_fold", "copy", F.col("class_idx").alias("label"), F.array(*learn.TRACE_FEATURES).alias("x"))
    scaled = lockstep.scales(rows, keys, learn._fold_member, 6)
    model = kind(6, 2)
    weights = lockstep.fit(rows, keys, learn._fold_member, model, scaled, 25)
    x, y = own_rows(folded, 2, 3)
    assert scaled[2, 3][0] == len(x) and np.allclose(scaled[2, 3][1], x.mean(0)) and np.allclose(scaled[2, 3][2], x.std(0))
    z = (x - x.mean(0)) / x.std(0)
    w, memory = model.start(), {}
    for _ in range(25):
        w, done = model.step(w, model.partial(w, z, y), len(x), memory)
        if done:
            break
    assert np.allclose(weights[2, 3], w, atol=1e-6)
    assert (model.probabilities(w, z).argmax(1) == y).mean() > 0.6
    if kind is lockstep.Logistic:
        one = np.concatenate([z, np.ones((len(z), 1))], 1)
        p = 1 / (1 + np.exp(-one @ w))
        ridge = lockstep.RIDGE * len(x) * np.array([1.0] * 6 + [1e-6])
        assert np.abs(one.T @ (p - y) + ridge * w).max() < 1e-6


def test_comparison_of_models_over_folds_and_factors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (rng.normal(size=10) * (1 + 2 * (i % 2))).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "trace_id long, class_idx int, values array<double>")
    found = learn.fold_metrics(learn.cross_validate(df, 2, [0, 3], ["forest", "logistic", "perceptron"], 2, trees=5), 2).collect()
    assert len(found) == 12 and all(r.n_val == 40 for r in found)
    assert all(np.mean([r.accuracy for r in found if r.model == m]) > 0.7 for m in ("forest", "logistic", "perceptron"))


def test_votes_of_a_forest_are_its_probabilities(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, *[float(v) for v in rng.normal(i % 2, 1.5, 3)]) for i in range(90)] + [(500, 1, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "trace_id long, class_idx int, a double, b double, c double")
    model = learn.forest(15).fit(learn.assembled(df, ("a", "b", "c"), "class_idx"))
    want = {r.trace_id: r.probs for r in learn.score(model, df, ("a", "b", "c"), "class_idx").collect()}
    votes = learn.forest_votes(model, df, ("a", "b", "c"), "class_idx")
    assert votes.count() == 90 * 15 * 2
    means = {(r.trace_id, r["class"]): r.p for r in votes.groupBy("trace_id", "class").agg(F.avg("prob").alias("p")).collect()}
    assert len(want) == 90 and all(means[i, c] == pytest.approx(p[c]) for i, p in want.items() for c in (0, 1))
    sure = {r.trace_id: r for r in certainty.certainty(votes, ["trace_id", "label"]).collect()}
    each = {}
    for r in votes.collect():
        each.setdefault((r.trace_id, r["class"]), []).append(r.prob)
    for i in want:
        assert sure[i].wd == pytest.approx(np.abs(np.sort(each[i, 0]) - np.sort(each[i, 1])).mean())


def test_a_tree_by_hand_and_even_votes(spark):
    """One split between 2 and 3: the leaves' shares are those of their rows; equal shares give class 1."""
    df = spark.createDataFrame([(i, y, float(x)) for i, (x, y) in enumerate([(1, 0), (2, 0), (3, 1), (4, 1)])] * 5, "trace_id long, class_idx int, a double")
    tree = learn.forest(1).setSubsamplingRate(1.0).setBootstrap(False).fit(learn.assembled(df, ("a",), "class_idx"))
    found = {r.trace_id: (r.probs, r.pred) for r in learn.score(tree, df, ("a",), "class_idx").collect()}
    assert found == {0: ([1.0, 0.0], 0), 1: ([1.0, 0.0], 0), 2: ([0.0, 1.0], 1), 3: ([0.0, 1.0], 1)}
    even = spark.createDataFrame([([0.5, 0.5],), ([0.6, 0.4],), ([0.4, 0.4, 0.2],)], "p array<double>")
    assert [r[0] for r in even.select(learn.predicted(F.col("p"))).collect()] == [1, 0, 0]
    assert metrics.accuracy(df.select(F.col("class_idx").alias("label"), F.lit(1).alias("pred"))).first()[0] == 0.5


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(10)
    groups = {"a": rng.normal(size=500).tolist(), "b": rng.integers(0, 4, 333).astype(float).tolist(), "c": [7.0], "d": [1.0, 1.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {r.g: (r.n, r.q) for r in ordered.quantiles(df, ["g"], "v", shares).collect()}
    assert found.keys() == {*groups, None} and found[None] == (2, pytest.approx(np.quantile([3, 5], shares).tolist()))
    for g, own in groups.items():
        assert found[g] == (len(own), pytest.approx(np.quantile(own, shares).tolist()))
    assert ordered.quantiles(df.where("g = 'd'"), [], "v", [0.3]).first().q == [1.0]
    assert ordered.quantiles(df.where("false"), ["g"], "v", [0.3]).collect() == [] and tuple(ordered.quantiles(df.where("false"), [], "v", [0.3]).first()) == (None, [None])


def test_coverage_of_equal_values_and_of_single_ones(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", 4.0), ("b", 100.0), ("c", float("nan")), ("c", 1.0)], "g string, v double")
    assert tuple(stats.coverage_range(df, "g", "v").first()) == pytest.approx((4 - 0.2 - 1e-9, 4 + 0.2 + 1e-9))
    wide = df.unionByName(spark.createDataFrame([("d", float(v)) for v in range(11)], "g string, v double"))
    assert tuple(stats.coverage_range(wide, "g", "v").first()) == pytest.approx((1 - 0.4, 9 + 0.4))


def test_wide_columns_number_by_ranges(spark):
    df = spark.createDataFrame([("x", 3, 1.0), ("x", 1, 2.0), ("y", 2, 5.0)], "g string, at int, v double")
    assert sorted(tuple(r) for r in stats.wide_columns(df, "g", ["x", "y"], "v", ["at"]).collect()) == [(0, 2.0, 5.0), (1, 1.0, None)]


def test_a_resumed_sink_holds_every_trace_once(spark):
    path = scratch.folder(spark, "test-sink")
    kind = "movie int, trace_id int, compound string, gt_label string, origin string, norm string, values array<double>"
    rows = spark.createDataFrame([(m, m * 10 + i, f"c{i % 2}", "IN", "protein", "raw", [1.0]) for m in range(4) for i in range(5)], kind)
    movies = spark.createDataFrame([(m,) for m in range(6)], "movie int")  # two movies without traces

    failing = F.udf(lambda i: 1 // (i - 12), "int")  # fails in movie 1
    with pytest.raises(Exception, match="ZeroDivision|division"):
        sinks.write_resumable(rows.withColumn("trace_id", F.col("trace_id") + 0 * failing("trace_id")), movies, path)
    assert sinks.finished(spark, path).count() == 0
    assert sinks.write_resumable(rows, movies.where("movie in (0, 4)"), path) == 2
    left = rows.where("movie = 2").unionByName(rows.where("movie = 2").withColumn("gt_label", F.lit("OUT"))).withColumn("attempt", F.lit("lost"))
    left.write.mode("append").partitionBy(*sinks.PARTITIONS, "movie").parquet(f"{path}/traces")  # written, but never entered
    assert sinks.write_resumable(rows, movies, path) == 4
    assert sinks.write_resumable(rows, movies, path) == 0
    found = sinks.read_resumable(spark, path)
    assert sorted((r.movie, r.trace_id, r.gt_label) for r in found.collect()) == sorted((str(r.movie), r.trace_id, "IN") for r in rows.collect())
    assert {r.movie: r.traces for r in sinks.finished(spark, path).collect()} == {"0": 5, "1": 5, "2": 5, "3": 5, "4": 0, "5": 0}


def painted(boxes, box, threshold):
    """Boxes (roi, x, y) painted in the order of roi: those that share more than threshold visible pixels with one they hide, and the hidden."""
    shown, shared = {}, {}
    for roi, x, y in sorted(boxes):
        for px, py in itertools.product(range(x, x + box), range(y, y + box)):
            if (px, py) in shown:
                shared[roi, shown[px, py]] = shared.get((roi, shown[px, py]), 0) + 1
            shown[px, py] = roi
    return {r for pair, n in shared.items() if n > threshold for r in pair}


def test_nested_settings_equal_settings_one_by_one(spark):
    rng = random.Random(11)
    locs = [(m, rng.uniform(3, 40), rng.uniform(3, 40), rng.choice([5.0, 10.0, 14.0, 20.0, 33.0])) for m in (1, 2) for _ in range(60)]
    spots = [(m, rng.randrange(38), rng.randrange(38), rng.choice([1.0, 2.0, 3.0])) for m in (1, 2) for _ in range(25)]
    df = spark.createDataFrame(locs, "movie_id int, x double, y double, net_gradient double")
    gt = spark.createDataFrame(spots, "movie_id int, x int, y int, net_gradient double")
    found = {(r.gradient, r.spot_gradient, r.movie_id): (r.n_single, r.n_in, r.n_overlapping, r.objective) for r in parameters.grid_sweep(df, gt, [20.0, 10.0, 14.0], 5, 3.0, 50, 50, 3, [2.0, 3.0]).collect()}
    assert len(found) == 12
    for g, sg, m in found:
        corners = {(int(np.round(x - 2.5)), int(np.round(y - 2.5))) for k, x, y, n in locs if k == m and n >= g}
        boxes = [((y + 5) * 60 + x + 6, x, y) for x, y in corners]
        hidden = painted(boxes, 5, 3)
        single = [b for b in boxes if b[0] not in hidden]
        inside = sum(any(k == m and n >= sg and (a - x) ** 2 + (b - y) ** 2 < 9 for k, a, b, n in spots) for _, x, y in single)
        total = len(boxes)
        want = len(single) * (1 + inside / max(len(single), 1)) * (1 - len(hidden) / total) ** 2
        assert found[g, sg, m] == (len(single), inside, len(hidden), pytest.approx(want))
    plain = parameters.grid_sweep(df, gt, [10.0], 5, 3.0, 50, 50, 3)
    assert plain.columns == ["gradient", "movie_id", "n_single", "n_in", "n_overlapping", "objective"] and plain.count() == 2
    best = parameters.best_setting(parameters.grid_sweep(df, gt, [20.0, 10.0, 14.0], 5, 3.0, 50, 50, 3, [2.0, 3.0])).first()
    means = {k: np.mean([v[3] for (g, s, _), v in found.items() if (g, s) == k]) for k in {(g, s) for g, s, _ in found}}
    assert best.pooled == pytest.approx(max(means.values())) and means[best.gradient, best.spot_gradient] == pytest.approx(best.pooled)
