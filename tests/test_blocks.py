"""Links found block by block, against all pairs."""

import random

import numpy as np
import pytest

from tracework.operators import blocks, spatial


def reached(n, a, b):
    root = np.arange(n)
    for _ in range(n):
        before = root.copy()
        for i, j in zip(a, b, strict=True):
            root[i] = root[j] = min(root[i], root[j])
        if (root == before).all():
            return root
    return root


def places(seed, n, side):
    """(id, movie, frame, x, y), some on a grid so that distances are met exactly, in negative places too, sorted by id."""
    rng = random.Random(seed)
    some = lambda: rng.choice([rng.randint(-side, side) / 2, rng.uniform(-side, side)])
    return sorted((rng.randrange(10**9), rng.randrange(2), rng.randint(-9, 12), some(), some()) for _ in range(n))


@pytest.mark.parametrize(("radii", "spans", "side"), [(1, 1, 9), (3, 2, 14), (64, 16, 9)])
def test_links_by_small_blocks(spark, monkeypatch, radii, spans, side):
    """Molecules through many blocks; repeated rows count once, rows without a place or frame stay alone."""
    monkeypatch.setattr(spatial, "BLOCK_RADII", radii)
    monkeypatch.setattr(spatial, "BLOCK_SPANS", spans)
    rows = places(radii, 300, side)
    ids, movie, frame, x, y = (np.array(c) for c in zip(*rows, strict=True))
    apart = np.abs(frame[:, None] - frame)
    near = (movie[:, None] == movie) & (apart > 0) & (apart <= 3) & ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 2.25)
    root = reached(len(ids), *np.nonzero(np.triu(near)))
    want = {int(ids[r]): (int((root == r).sum()), x[root == r].mean(), y[root == r].mean()) for r in set(root.tolist())}
    odd = [(1, None, 1, 0.0, 0.0), (2, 1, None, 0.0, 0.0), (3, 1, 1, None, 0.0)]
    df = spark.createDataFrame([*rows, *rows[::3], *odd], "id long, movie_id int, frame int, x double, y double").repartition(5)
    found = {r.molecule: (r.n, r.x, r.y) for r in spatial.link_localizations(df, 1.5, 2).collect()}
    assert {found.pop(i)[0] for i in (1, 2, 3)} == {1}
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i]) for i in want)
    assert spatial.link_localizations(df.where("false"), 1.5, 2).collect() == []


@pytest.mark.parametrize(("radii", "side", "least"), [(2, 9, 3), (2, 14, 4), (5, 9, 2), (2, 30, 1), (64, 12, 4)])
def test_clusters_by_small_blocks(spark, monkeypatch, radii, side, least):
    """Clusters through many blocks, and points that are no cores between clusters of different blocks."""
    monkeypatch.setattr(spatial, "BLOCK_RADII", radii)
    rows = places(radii + least, 350, side)
    ids, movie, _, x, y = (np.array(c) for c in zip(*rows, strict=True))
    near = (movie[:, None] == movie) & ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 2.25)
    core = near.sum(1) >= least
    root = reached(len(ids), *np.nonzero(np.triu(near & core & core[:, None])))
    own = np.where(core, root, np.where(near & core, root, len(ids)).min(1))
    want = {int(ids[r]): (int((own == r).sum()), x[own == r].mean(), y[own == r].mean()) for r in set(own.tolist()) - {len(ids)}}
    df = spark.createDataFrame([*rows, *rows[::4], (1, None, 1, 0.0, 0.0), (2, 1, 1, None, 0.0)], "id long, movie_id int, frame int, x double, y double").repartition(5)
    found = {r.cluster: (r.n, r.x, r.y) for r in spatial.density_clusters(df, 1.5, least).collect()}
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i]) for i in want)


@pytest.mark.parametrize("gap", [0.999, 1.0, 1.001])
def test_large_sets_touch(monkeypatch, gap):
    monkeypatch.setattr(blocks, "BRUTE", 50)
    rng = np.random.default_rng(2)
    p, q = rng.uniform(0, 1, (400, 2)), rng.uniform(0, 1, (300, 2)) + [3, 0]
    p[7], q[9] = (1.0, 0.25), (1 + gap, 0.25)
    assert blocks.touch(p, q, 1.0) == (gap <= 1)
    assert blocks.touch(np.ones((100, 2)), np.ones((100, 2)) * [1, 2], 1.0) and not blocks.touch(np.ones((100, 2)), np.ones((100, 2)) * [1, 2.1], 1.0)


def test_points_move_once(spark):
    """Neither a copy for each near cell nor one for each pair: what is dealt is a chunk for each block and task, of a few bytes a point."""
    rows = [(i, 1, float(i % 50), float(i % 37)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, movie_id int, x double, y double").coalesce(2)
    chunks = blocks.dealt(df, {"x": (100.0, 3.0, 1.5, True), "y": (100.0, 3.0, 1.5, True)}).collect()
    own = [r for r in chunks if r.bx == r.by == 0]
    assert sum(int.from_bytes(r.chunk[:8], "little") for r in own) == 20_000 and len(own) == 2
    assert sum(int.from_bytes(r.chunk[:8], "little") for r in chunks) < 25_000 and sum(len(r.chunk) for r in chunks) < 200_000
