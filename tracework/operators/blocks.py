"""Neighbour links of points, found block by block.

Space (and time) is cut into blocks much wider than the reach of a link. A point is sent once to its own block, and as a copy to those blocks whose
rim it lies in, in packed chunks of many points: it moves once, however many links it has. A block's links are found and contracted in its task,
so what leaves it are sums for each of its components, and the components of points that other blocks see too. Only these go on to
:func:`tracework.operators.components.components`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import smallest

#: Points that a task packs at once.
PACKED = 400_000
#: Candidate pairs that are compared at once.
PAIRS = 2_000_000
#: Two sets of points with more pairs are cut into boxes first.
BRUTE = 1 << 20
#: A copy is sent if a point is within the reach of a block, and a little beyond for rounding.
MARGIN = 1 + 1e-9
OWN, SHARED, INNER = 1, 2, 4


def dealt(points: DataFrame, axes: dict[str, tuple[float, float, float, bool]]) -> DataFrame:
    """movie_id, the block's number along each axis, chunk: points (id, movie_id and the axes, none missing), a block's chunks standing together.

    axes: name -> (a block's width, reach, inner, both): copies go to the block below if a point is within the reach of its upper end, with ``both`` also upwards;
    a width is as large as the reach at least. The axes' values are packed as doubles behind the ids, then flags: OWN in a point's own block, INNER there and in copies
    within ``inner`` of a block, SHARED where a point is in a block as a copy, and in its own if it has a copy that is INNER.
    """
    names = list(axes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield flushed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield flushed(pa.Table.from_batches(held))

    def flushed(table: pa.Table) -> pa.RecordBatch:
        movies = table["movie_id"].combine_chunks().dictionary_encode()
        code = movies.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = table["id"].to_numpy()
        values = [table[a].to_numpy().astype(np.float64) for a in names]
        homes = [np.floor(v / axes[a][0]).astype(np.int64) for v, a in zip(values, names, strict=True)]
        moves = []  # of each axis: (step, rows that go there, those within inner)
        for v, home, a in zip(values, homes, names, strict=True):
            width, reach, inner, both = axes[a]
            low, high = v - home * width, (home + 1) * width - v
            moves.append([(0, None, None), (-1, low <= reach * MARGIN, low <= inner * MARGIN)] + ([(1, high <= reach * MARGIN, high <= inner * MARGIN)] if both else []))
        rows, blocks, flags = [np.arange(len(ids))], [homes], [np.full(len(ids), OWN | INNER, np.uint8)]
        for way in itertools.product(*moves):
            there = [(ok, inner) for step, ok, inner in way if step]
            if there:
                at = np.flatnonzero(np.logical_and.reduce([ok for ok, _ in there]))
                inner = np.logical_and.reduce([i[at] for _, i in there])
                rows.append(at)
                blocks.append([home[at] + step for home, (step, *_) in zip(homes, way, strict=True)])
                flags.append(np.where(inner, SHARED | INNER, SHARED).astype(np.uint8))
                flags[0][at[inner]] |= SHARED
        rows, flags = np.concatenate(rows), np.concatenate(flags)
        block = np.stack([code[rows], *[np.concatenate(part) for part in zip(*blocks, strict=True)]])
        order = np.lexsort(block[::-1])
        rows, flags, block = rows[order], flags[order], block[:, order]
        first = np.flatnonzero(np.concatenate([[True], (block[:, 1:] != block[:, :-1]).any(0)]))
        chunks = []
        for a, b in itertools.pairwise([*first.tolist(), len(rows)]):
            own = rows[a:b]
            packed = b"".join([ids[own].tobytes(), *[v[own].tobytes() for v in values], flags[a:b].tobytes()])
            chunks.append(len(own).to_bytes(8, "little") + pa.compress(packed, "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([movies.dictionary.take(pa.array(block[0, first])), *[pa.array(block[i + 1, first]) for i in range(len(names))], pa.array(chunks, pa.binary())], ["movie_id", *[f"b{a}" for a in names], "chunk"])

    movie = points.schema["movie_id"].dataType.simpleString()
    keys = ["movie_id", *[f"b{a}" for a in names]]
    packed = points.select("movie_id", F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in names])
    chunks = packed.mapInArrow(pack, f"movie_id {movie}, " + ", ".join(f"b{a} long" for a in names) + ", chunk binary")
    return chunks.repartition(*keys).sortWithinPartitions(*keys)


def solved(chunks: DataFrame, axes: int, solve: Callable) -> DataFrame:
    """movie_id, kind, node, root, n, x, y, open: what ``solve(ids, values, flags)`` gives of each block, its ids sorted and each once.

    kind 0: sums of a component of the block (n, x and y of the points that it counts; open if other blocks may know it), 1: a shared point and its
    component, 2: a point that several components want, once for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for i, now in enumerate(zip(*columns, strict=True)):
                if held and now != key:
                    yield from block(key, held)
                    held = []
                key = now
                held.append(batch.column(batch.num_columns - 1)[i].as_py())
        if held:
            yield from block(key, held)

    def block(key: tuple, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = []
        for chunk in held:
            n = int.from_bytes(chunk[:8], "little")
            raw = pa.decompress(chunk[8:], n * (8 * axes + 9), "zstd", asbytes=True)
            parts.append([np.frombuffer(raw, np.int64, n), *[np.frombuffer(raw, np.float64, n, 8 * n * (i + 1)) for i in range(axes)], np.frombuffer(raw, np.uint8, n, 8 * n * (axes + 1))])
        ids, *values, flags = (np.concatenate(p) for p in zip(*parts, strict=True))
        ids, first = np.unique(ids, return_index=True)
        for kind, columns in enumerate(solve(ids, [v[first] for v in values], flags[first])):
            n = len(columns["root"])
            if n:
                filled = {"node": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()), "x": pa.nulls(n, pa.float64()), "y": pa.nulls(n, pa.float64()), "open": pa.nulls(n, pa.bool_())} | {c: pa.array(v) for c, v in columns.items()}
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], movie).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, kind, np.int32)), *[filled[c] for c in ("node", "root", "n", "x", "y", "open")]], ["movie_id", "kind", "node", "root", "n", "x", "y", "open"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunks.schema["movie_id"].dataType
    movie = to_arrow_type(kind)
    return chunks.mapInArrow(run, f"movie_id {kind.simpleString()}, kind int, node long, root long, n long, x double, y double, open boolean")


def _sums(root: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, open_: np.ndarray) -> dict:
    """Sums of points by root (a place in ids); open_ is told for every place."""
    n = np.bincount(root, minlength=len(ids))
    at = np.flatnonzero(n)
    return {"root": ids[at], "n": n[at], "x": np.bincount(root, x, len(ids))[at], "y": np.bincount(root, y, len(ids))[at], "open": open_[at]}


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j from low[i] to high[i], about PAIRS at once."""
    sizes = high - low
    upto = np.cumsum(sizes)
    a = 0
    while a < len(low):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        n = sizes[a:b]
        start = np.cumsum(n) - n
        i = np.repeat(np.arange(a, b), n)
        yield i, np.arange(n.sum()) - np.repeat(start, n) + low[i]
        a = b


def link_solver(radius: float, span: int) -> Callable:
    """Points (frame, x, y) of different frames, at most span apart and within the radius, are linked."""

    def solve(ids: np.ndarray, values: list[np.ndarray], flags: np.ndarray) -> tuple:
        frame, x, y = values
        side = radius * MARGIN  # so rounding puts no pair two cells apart
        cell = [np.floor(frame / span), np.floor(y / side), np.floor(x / side)]
        ct, cy, cx = ((c - c.min() + 1).astype(np.int64) for c in cell)
        ny, nx = int(cy.max()) + 2, int(cx.max()) + 2
        key = (ct * ny + cy) * nx + cx
        order = np.argsort(key, kind="stable")
        key, frame_, x_, y_ = key[order], frame[order], x[order], y[order]
        ends = [], []
        for dt, dy, left, right in ((0, 0, 0, 1), (0, 1, -1, 1), (1, -1, -1, 1), (1, 0, -1, 1), (1, 1, -1, 1)):
            near = key + (dt * ny + dy) * nx
            low, high = np.searchsorted(key, near + left, side="left"), np.searchsorted(key, near + right, side="right")
            if not dt and not dy:
                low = np.arange(1, len(key) + 1)  # a pair of one cell or of a cell and the next counts once
                high = np.maximum(high, low)
            for i, j in _ranges(low, high):
                apart = np.abs(frame_[i] - frame_[j])
                dx, dy_ = x_[i] - x_[j], y_[i] - y_[j]
                ok = (apart > 0) & (apart <= span) & (dx * dx + dy_ * dy_ <= radius * radius)
                ends[0].append(order[i[ok]])
                ends[1].append(order[j[ok]])
        root = smallest(len(ids), np.concatenate(ends[0]), np.concatenate(ends[1]))
        open_ = np.zeros(len(ids), bool)
        shared = np.flatnonzero(flags & SHARED)
        open_[root[shared]] = True
        own = np.flatnonzero(flags & OWN)
        return _sums(root[own], x[own], y[own], ids, open_), {"node": ids[shared], "root": ids[root[shared]]}

    return solve


def touch(p: np.ndarray, q: np.ndarray, limit: float) -> bool:
    """Whether a point of p (n, 2) is within the square root of limit of one of q; sets of any size cost the boxes along one another's rim, not their pairs."""
    if len(p) * len(q) <= BRUTE:
        return bool((((p[:, None] - q[None]) ** 2).sum(2) <= limit).any())
    (pa_, pb, p_of), (qa, qb, q_of) = _boxed(p), _boxed(q)
    gap = np.maximum(0, np.maximum(pa_[:, None] - qb[None], qa[None] - pb[:, None]))
    reach = np.maximum(pb[:, None] - qa[None], qb[None] - pa_[:, None])
    if ((reach**2).sum(2) <= limit).any():
        return True
    return any(touch(p[p_of == i], q[q_of == j], limit) for i, j in zip(*np.nonzero((gap**2).sum(2) <= limit), strict=True))


def _boxed(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower corners, upper corners, the box of each point) of at most 256 boxes."""
    low, size = p.min(0), np.ptp(p, axis=0)
    at = np.minimum(15, ((p - low) / np.where(size > 0, size, 1) * 16).astype(int))
    _, of = np.unique(at[:, 0] * 16 + at[:, 1], return_inverse=True)
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    return np.minimum.reduceat(p[order], first), np.maximum.reduceat(p[order], first), of


def density_solver(radius: float, least: int) -> Callable:
    """Points (x, y) with at least ``least`` points within the radius are cores, linked within the radius; other points go to the cores near them.

    Cells are as wide as makes any two of their points neighbours, so points of a cell with ``least`` are cores unseen and the cores of a cell are linked.
    INNER points have all of their neighbours in the block.
    """
    size, limit = radius / np.sqrt(2), radius * radius

    def solve(ids: np.ndarray, values: list[np.ndarray], flags: np.ndarray) -> tuple:
        cx, cy = (np.floor(v / size) for v in values)
        cx, cy = (cx - cx.min() + 2).astype(np.int64), (cy - cy.min() + 2).astype(np.int64)
        nx = int(cx.max()) + 3
        key = cy * nx + cx
        order = np.argsort(key, kind="stable")
        key, (x, y), flag = key[order], (v[order] for v in values), flags[order]
        cells, cell, count = np.unique(key, return_inverse=True, return_counts=True)

        def near(of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(place in of, place) of points within the radius of those of ``of``."""
            for dy in range(-2, 3):
                at = key[of] + dy * nx
                for i, j in _ranges(np.searchsorted(key, at - 2, side="left"), np.searchsorted(key, at + 2, side="right")):
                    dx, dy_ = x[of[i]] - x[j], y[of[i]] - y[j]
                    ok = dx * dx + dy_ * dy_ <= limit
                    yield i[ok], j[ok]

        core = count[cell] >= least
        thin = np.flatnonzero(~core & (flag & INNER > 0))
        met = np.zeros(len(thin), np.int64)
        for i, _ in near(thin):
            met += np.bincount(i, minlength=len(thin))
        core[thin[met >= least]] = True
        core &= flag & INNER > 0
        cores = np.flatnonzero(core)
        if not len(cores):
            return ()
        kept, of = np.unique(cell[cores], return_inverse=True)  # cells with cores
        group = _linked(cells[kept], of, np.stack([x[cores], y[cores]], 1), nx, limit)  # by cell
        rank = order[cores]  # places in ids, which are sorted
        low = np.full(len(kept), len(ids))
        np.minimum.at(low, group[of], rank)
        root = np.full(len(ids), -1)  # by place here, as a place in ids
        root[cores] = low[group[of]]
        open_ = np.zeros(len(ids), bool)
        shared = cores[flag[cores] & SHARED > 0]
        open_[root[shared]] = True
        # points that are no cores go to the smallest cluster near them, which is known here if they see one component only
        loose = np.flatnonzero(~core & (flag & OWN > 0))
        seen = [np.stack([i[core[j]], root[j[core[j]]]], 1) for i, j in near(loose)]
        seen = np.unique(np.concatenate([s[np.flatnonzero(np.diff(s[:, 0] * len(ids) + s[:, 1], prepend=-1))] for s in seen]), axis=0) if len(loose) else np.zeros((0, 2), np.int64)
        wants = np.bincount(seen[:, 0], minlength=len(loose))[seen[:, 0]]
        open_[seen[wants > 1, 1]] = True
        own = cores[flag[cores] & OWN > 0]
        sure, torn = seen[wants == 1], seen[wants > 1]
        counted = np.concatenate([own, loose[sure[:, 0]]])
        sums = _sums(np.concatenate([root[own], sure[:, 1]]), x[counted], y[counted], ids, open_)
        at = loose[torn[:, 0]]
        return sums, {"node": ids[order[shared]], "root": ids[root[shared]]}, {"node": ids[order[at]], "root": ids[torn[:, 1]], "x": x[at], "y": y[at]}

    return solve


def _linked(cells: np.ndarray, of: np.ndarray, points: np.ndarray, nx: int, limit: float) -> np.ndarray:
    """The first linked cell of each cell; of: the cell (by place) of each point, in order. A witness is looked for among the outermost points of two cells first."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    last = np.append(first[1:], len(of))
    low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
    outer = []
    for axis in (0, 1):
        for way in (1, -1):
            outer.append(np.lexsort((way * points[:, axis], of))[first])
    a, b = [], []
    for dy in range(3):
        for dx in range(-2, 3):
            if (dy, dx) > (0, 0) and dy + abs(dx) < 4:
                at = np.searchsorted(cells, cells + dy * nx + dx)
                hit = np.flatnonzero(cells[np.minimum(at, len(cells) - 1)] == cells + dy * nx + dx)
                a.append(hit)
                b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
    can = (gap**2).sum(1) <= limit
    a, b = a[can], b[can]
    found = np.zeros(len(a), bool)
    for p in outer:
        for q in outer:
            found |= ((points[p[a]] - points[q[b]]) ** 2).sum(1) <= limit
    group = smallest(len(cells), a[found], b[found])
    rest = np.flatnonzero(group[a] != group[b])
    sizes = (last - first)[a] * (last - first)[b]
    small = rest[sizes[rest] <= BRUTE]
    while len(small):
        part = small[: max(1, int(np.searchsorted(np.cumsum(sizes[small]), PAIRS, side="right")))]
        n, m = (last - first)[a[part]], (last - first)[b[part]]
        which = np.repeat(np.arange(len(part)), n * m)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        p, q = first[a[part]][which] + inside // m[which], first[b[part]][which] + inside % m[which]
        hit = part[np.unique(which[((points[p] - points[q]) ** 2).sum(1) <= limit])]
        found[hit] = True
        small = small[len(part) :]
    group = smallest(len(cells), a[found], b[found])
    for i in rest[sizes[rest] > BRUTE]:
        if group[a[i]] != group[b[i]] and touch(points[first[a[i]] : last[a[i]]], points[first[b[i]] : last[b[i]]], limit):
            found[i] = True
            group = smallest(len(cells), a[found], b[found])
    return group
