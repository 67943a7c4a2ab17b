"""Spatial joins of localizations, boxes (ROIs) and pixels.

Distances become equi-joins: points are put into grid cells as wide as the
distance, and one side is sent to the 3 x 3 cells around it. A box is exploded
into its pixels for overlap, an equi-join on pixels; sums are looked up at its corner.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeded import order_key
from ..sources.scratch import cut, folder
from . import blocks
from .components import components, contracted, salted
from .ordered import quantiles


def corner(centre: Column, box: int) -> Column:
    """Box corner: half-even rounding of centre - box / 2; 0 where that isn't finite."""
    at = centre - F.lit(box / 2)
    ok = at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf"))
    return F.when(ok, F.bround(F.when(ok, at), 0)).otherwise(0.0).cast("int")


def _cells(points: DataFrame, size: float, around: bool) -> DataFrame:
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not around:
        return points.withColumns({"cx": cx, "cy": cy})
    near = F.array(*[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return points.withColumn("_c", F.explode(near)).select(*points.columns, "_c.cx", "_c.cy")


def pairs_within(left: DataFrame, right: DataFrame, distance: float, keys: list[str], strict: bool = True) -> DataFrame:
    """Rows of left (l struct) with rows of right (r struct) nearer than distance and of equal keys; d2 is the squared distance."""
    a = _cells(left, distance, False).select(*keys, "cx", "cy", F.struct(*left.columns).alias("l"))
    b = _cells(right, distance, True).select(*keys, "cx", "cy", F.struct(*right.columns).alias("r"))
    d2 = (F.col("l.x") - F.col("r.x")) ** 2 + (F.col("l.y") - F.col("r.y")) ** 2
    limit = F.lit(float(distance) ** 2)
    return a.join(b, [*keys, "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < limit if strict else F.col("d2") <= limit).drop("cx", "cy")


def label_by_nearest(rois: DataFrame, spots: DataFrame, distance: float) -> DataFrame:
    """rois, then nearest (NULL where none is near) and ground_truth: IN where a spot of the movie is nearer than distance, else OUT."""
    near = pairs_within(rois, spots, distance, ["movie_id"]).groupBy("movie_id", F.col("l.roi").alias("roi")).agg(F.sqrt(F.min("d2")).alias("nearest"))
    return rois.join(near, ["movie_id", "roi"], "left").withColumn("ground_truth", F.when(F.col("nearest").isNotNull(), "IN").otherwise("OUT"))


def background_buffer(background: DataFrame, proteins: DataFrame, buffer: float) -> DataFrame:
    """Background boxes without a protein box of the movie within buffer (inclusive); 0 keeps all."""
    if buffer == 0:
        return background
    near = pairs_within(background, proteins, buffer, ["movie_id"], strict=False).select("movie_id", F.col("l.roi").alias("roi")).distinct()
    return background.join(near, ["movie_id", "roi"], "left_anti")


def box_pixels(rois: DataFrame, box: int, width: int, height: int) -> DataFrame:
    """movie_id, roi, px, py of each box, clipped at the right and bottom; a box with a negative corner has no pixels."""
    rows = rois.where("x >= 0 and y >= 0").select("movie_id", "roi", "y", F.explode(F.expr(f"sequence(x, x + {box - 1})")).alias("px"))
    rows = rows.select("movie_id", "roi", "px", F.explode(F.expr(f"sequence(y, y + {box - 1})")).alias("py"))
    return rows.where((F.col("px") < width) & (F.col("py") < height))


def painter_overlaps(rois: DataFrame, box: int, threshold: int, width: int, height: int) -> DataFrame:
    """(movie_id, roi) of overlapping boxes, painted in the order of roi: each pixel shows the last box before.

    i and the box j it hides are flagged when they share more than threshold visible pixels; box i is skipped if it only hides box 0.
    """
    shown = box_pixels(rois, box, width, height).withColumn("under", F.lag("roi").over(W.partitionBy("movie_id", "px", "py").orderBy("roi")))
    shared = shown.where("under is not null").groupBy("movie_id", "roi", "under").agg(F.count(F.lit(1)).alias("n"), )
    counted = shared.withColumn("highest", F.max("under").over(W.partitionBy("movie_id", "roi"))).where((F.col("n") > threshold) & (F.col("highest") > 0))
    return counted.select("movie_id", F.explode(F.array("roi", "under")).alias("roi")).distinct()


def pairwise_overlaps(rois: DataFrame, box: int, threshold: int) -> DataFrame:
    """(movie_id, a, b, area) of boxes that share more than threshold pixels, whatever lies above."""
    other = rois.select("movie_id", F.col("roi").alias("r"), "x", "y")
    found = pairs_within(rois, other.withColumnRenamed("r", "roi"), float(box) * 1.5, ["movie_id"]).where("l.roi < r.roi")
    side = lambda c: F.greatest(F.lit(0), F.lit(box) - F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")))
    return found.select("movie_id", F.col("l.roi").alias("a"), F.col("r.roi").alias("b"), (side("x") * side("y")).alias("area")).where(F.col("area") > threshold)


def corner_windows(pixels: DataFrame, box: int, width: int, height: int) -> DataFrame:
    """movie_id, frame, x, y, intensity: the sum over the box at each corner from (0, 0) on whose box, clipped at the right and bottom, has a pixel of the frame.

    A frame is one image and is summed in one task, along x and then along y: the work doesn't grow with the number of boxes over a pixel.
    A sum over missing values only is NULL.
    """
    whole = pixels.schema["intensity"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = np.int64 if whole else np.float64
    names = ["movie_id", "frame", "x", "y", "intensity"]

    def slid(grid: np.ndarray) -> np.ndarray:
        """Sums of boxes by their corners, from box - 1 before the grid's first row and column on."""
        grid = np.pad(grid, box - 1)
        rows = sum(grid[:, i : grid.shape[1] - box + 1 + i] for i in range(box))
        return sum(rows[i : rows.shape[0] - box + 1 + i] for i in range(box))

    def one(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy().astype(np.int64), table["y"].to_numpy().astype(np.int64)
        x0, y0 = int(x.min()), int(y.min())
        at, shape = (y - y0, x - x0), (int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
        known = ~np.asarray(table["intensity"].is_null())
        value = table["intensity"].fill_null(0).to_numpy().astype(kind)
        total, seen, valued = np.zeros(shape, kind), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        np.add.at(total, at, value)
        np.add.at(seen, at, 1)
        np.add.at(valued, at, known)
        total, seen, valued = slid(total), slid(seen), slid(valued)
        cy, cx = np.nonzero(seen)
        fine = (cx + x0 - box + 1 >= 0) & (cy + y0 - box + 1 >= 0)
        cy, cx = cy[fine], cx[fine]
        first = pa.array(np.zeros(len(cx), np.int64))
        sums = pa.array(total[cy, cx], mask=valued[cy, cx] == 0)
        return pa.table([table["movie_id"].combine_chunks().take(first), table["frame"].combine_chunks().take(first), pa.array(cx + x0 - box + 1), pa.array(cy + y0 - box + 1), sums], names)

    kinds = {c: pixels.schema[c].dataType.simpleString() for c in ("movie_id", "frame")}
    inside = pixels.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height) & F.col("movie_id").isNotNull()).select(*names)
    return inside.groupBy("movie_id", "frame").applyInArrow(one, f"movie_id {kinds['movie_id']}, frame {kinds['frame']}, x long, y long, intensity {'long' if whole else 'double'}")


def box_sums(pixels: DataFrame, rois: DataFrame, box: int, width: int, height: int) -> DataFrame:
    """movie_id, roi, frame, intensity: pixels of each frame summed in each box; boxes of one (movie_id, roi) count together.

    A box looks up the sums at its corner: a row for each box and frame is joined, not one for each pixel in a box. A box with a negative corner has no pixels.
    """
    sums = corner_windows(pixels, box, width, height)
    boxes = rois.where("x >= 0 and y >= 0").select("movie_id", "roi", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return sums.join(boxes, ["movie_id", "x", "y"]).groupBy("movie_id", "roi", "frame").agg(F.sum("intensity").alias("intensity"))


def roi_traces(pixels: DataFrame, rois: DataFrame, overlapping: DataFrame, box: int, width: int, height: int) -> DataFrame:
    """rois, then overlap (single or overlapping) and values (by frame, 0 where a frame has no pixel; empty for overlapping boxes)."""
    flagged = rois.join(overlapping.withColumn("_o", F.lit(True)), ["movie_id", "roi"], "left").withColumn("overlap", F.when(F.col("_o"), "overlapping").otherwise("single")).drop("_o")
    sums = box_sums(pixels, flagged.where("overlap = 'single'"), box, width, height)
    traces = sums.groupBy("movie_id", "roi").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("intensity").cast("double").alias("v")))).alias("m"))
    frames = pixels.groupBy("movie_id").agg((F.max("frame") + 1).alias("n"))
    rows = flagged.join(traces, ["movie_id", "roi"], "left").join(frames, "movie_id", "left")
    entries = F.coalesce("m", F.array().cast("array<struct<frame:int,v:double>>"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))
    # each entry with the zeros of the frames that lie between it and the one before
    before = F.concat(F.array(F.lit(-1)), F.transform(entries, lambda e: e["frame"]))
    filled = F.flatten(F.zip_with(entries, F.slice(before, F.lit(1), F.size(before) - 1), lambda e, p: F.concat(zeros(e["frame"] - p - 1), F.array(e["v"]))))
    every = F.concat(filled, zeros(F.col("n") - 1 - F.element_at(before, -1)))
    return rows.withColumn("values", F.when((F.col("overlap") == "single") & F.col("n").isNotNull(), every).otherwise(F.array().cast("array<double>"))).drop("m", "n")


def _across(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(node, root) of nodes in several tiles or blocks -> (node, low: its smallest root), (low, top: roots that have a smaller one elsewhere, with the smallest)."""
    lowest = found.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots"))  # a node is in few tiles
    across = lowest.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("low").alias("b"))
    return lowest, components(across, name).select(F.col("node").alias("low"), F.col("root").alias("top"))


def tiled_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label: smallest node that each can reach by (tile, a, b) links, whose tile tells which links lie close together.

    The links of a tile are contracted where they meet, so that only the roots of tiles, joined where a node has several, go through the
    rounds over all links: a plane of cells, whose paths are long, costs rounds over its tiles instead.
    """
    lowest, above = _across(cut(contracted(links, "tile")), "spatial-tiles")
    # a tile's root that has a smaller root elsewhere counts by that; its own row tells so
    named = salted(lowest.select(F.col("node").alias("id"), "low"), above, ["low"], "id", how="left")
    return nodes.select("id").join(named.select("id", F.coalesce("top", "low").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _blocked(points: DataFrame, axes: dict[str, tuple[float, float, float, bool]], solve: Callable, name: str) -> DataFrame:
    """movie_id, root, n, x, y (means): the components of points that ``solve`` finds in blocks, joined where blocks share a point.

    The blocks' results are the only table that is written: sums of components, and what is needed to join those of several blocks.
    """
    spark = points.sparkSession
    path = folder(spark, name)
    blocks.solved(blocks.dealt(points, axes), len(axes), solve).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    _, above = _across(found.where("kind = 1").select("node", "root"), f"{name}-across")
    above = cut(above)
    topped = lambda rows, by: salted(rows.withColumnRenamed("root", "low"), above, ["low"], by, "left").withColumn("root", F.coalesce("top", "low"))
    sums = ["movie_id", "root", "n", "x", "y"]
    joined = topped(found.where("kind = 0 and open"), "n").select(*sums)
    torn = topped(found.where("kind = 2"), "node").groupBy("movie_id", "node").agg(F.min("root").alias("root"), F.first("x").alias("x"), F.first("y").alias("y"))
    whole = joined.unionByName(torn.select("movie_id", "root", F.lit(1).cast("long").alias("n"), "x", "y")).groupBy("movie_id", "root").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])
    every = found.where("kind = 0 and not open").select(*sums).unionByName(whole)
    return every.select("movie_id", "root", "n", (F.col("x") / F.col("n")).alias("x"), (F.col("y") / F.col("n")).alias("y"))


def _placed(*columns: str) -> Column:
    """Whether all columns have values, and finite ones."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return ok


#: A block is so many radii wide.
BLOCK_RADII = 64
#: And of so many spans of frames.
BLOCK_SPANS = 16


def link_localizations(locs: DataFrame, radius: float, dark: int) -> DataFrame:
    """Localizations (id, movie_id, frame, x, y) within radius (inclusive) and at most dark empty frames apart are one molecule.

    molecule (smallest id), movie_id, n, x, y (means). Localizations of one frame are not linked directly; those without a movie, frame or place are molecules of their own.
    Rows of equal id are one localization and have equal places.
    """
    span, side = dark + 1, BLOCK_RADII * radius
    ok = _placed("frame", "x", "y") & F.col("movie_id").isNotNull()
    axes = {"frame": (BLOCK_SPANS * span, span, span, False), "x": (side, radius, radius, False), "y": (side, radius, radius, False)}
    linked = _blocked(locs.where(ok), axes, blocks.link_solver(radius, span), "spatial-links")
    lone = locs.where(~ok).dropDuplicates(["id"]).select("movie_id", F.col("id").alias("root"), F.lit(1).cast("long").alias("n"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return linked.unionByName(lone).withColumnRenamed("root", "molecule")


def density_clusters(locs: DataFrame, radius: float, min_locs: int) -> DataFrame:
    """Localizations with at least min_locs (themselves included) within radius are cores; linked cores and their neighbours form a cluster.

    cluster (smallest core id), movie_id, n, x, y. A localization near cores of several clusters goes to the smallest. Localizations have an id, x and y.
    Rows of equal id are one localization and have equal places. A block knows all points within two radii, so all neighbours of those within one.
    """
    side = BLOCK_RADII * radius
    axes = {c: (side, 2 * radius, radius, True) for c in ("x", "y")}
    found = _blocked(locs.where(_placed("x", "y") & F.col("movie_id").isNotNull()), axes, blocks.density_solver(radius, min_locs), "spatial-density")
    return found.withColumnRenamed("root", "cluster")


def pixel_grid(movies: DataFrame, width: int, height: int) -> DataFrame:
    """movie_id, y, x: every pixel of every movie."""
    rows = movies.select("movie_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def summed_area(grid: DataFrame, value: str) -> DataFrame:
    """A full grid, then total: the sum of value over all pixels not right of or below each (a prefix sum along rows, then along columns)."""
    along = W.partitionBy("movie_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("movie_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, W.currentRow)
    return grid.withColumn("total", F.sum(value).over(along)).withColumn("total", F.sum("total").over(down))


def corner_sums(table: DataFrame, box: int) -> DataFrame:
    """A summed-area table, then box_sum: the sum over the box whose corner each pixel is, from four of its entries; NULL where the box doesn't fit."""
    down, along = W.partitionBy("movie_id", "x").orderBy("y"), W.partitionBy("movie_id", "y").orderBy("x")
    span = lambda c, w: F.lead(c, box - 1).over(w) - F.lag(c, 1, 0).over(w)
    return table.withColumn("box_sum", span("total", down)).withColumn("box_sum", span("box_sum", along))


def free_boxes(occupied: DataFrame, movies: DataFrame, box: int, width: int, height: int, edge: int, stride: int = 1) -> DataFrame:
    """movie_id, x, y: corners on the stride grid (every pixel by default) whose box touches no occupied pixel (movie_id, x, y).

    Corners lie from edge up to, and without, side - box - edge. A summed-area table gives each box in four look-ups, whatever its size.
    """
    marks = occupied.select("movie_id", "y", "x").distinct().withColumn("n", F.lit(1))
    grid = pixel_grid(movies, width, height).join(marks, ["movie_id", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    free = corner_sums(summed_area(grid, "n"), box).where("box_sum = 0")
    inside = lambda c, side: (F.col(c) >= edge) & (F.col(c) < side - box - edge) & ((F.col(c) - edge) % stride == 0)
    return free.where(inside("x", width) & inside("y", height)).select("movie_id", "x", "y")


def max_projection(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("movie_id", "y", "x").agg(F.max("intensity").alias("intensity"))


def contrast(projection: DataFrame, low: float = 0.01, high: float = 0.99, weight: float = 1.0) -> DataFrame:
    """projection, then value: stretched between two exact percentiles of its movie, clipped to [0, 1] and weighted."""
    ends = quantiles(projection, ["movie_id"], "intensity", [low, high]).select("movie_id", F.col("q").alias("e"))
    span = F.when(F.col("e")[1] > F.col("e")[0], F.col("e")[1] - F.col("e")[0]).otherwise(F.lit(1.0))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("intensity") - F.col("e")[0]) / span)) * F.lit(weight)
    return projection.join(ends, "movie_id").select(*projection.columns, value.alias("value"))


def spot_intensities(pixels: DataFrame, spots: DataFrame, box: int, width: int, height: int, frames: int = 10) -> DataFrame:
    """One row: n, min, max, mean, median, fold, p10, p90 of the box sums over the first frames; only boxes that lie wholly inside."""
    inside = spots.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + box <= width) & (F.col("y") + box <= height))
    sums = box_sums(pixels.where(F.col("frame") < frames), inside, box, width, height).groupBy("movie_id", "roi").agg(F.sum("intensity").alias("s"))
    sums = cut(sums)
    q = quantiles(sums, [], "s", [0.5, 0.1, 0.9]).select("q")
    whole = sums.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"), (F.max("s") / F.min("s")).alias("fold"))
    return whole.join(q, F.lit(True), "left").select("n", "min", "max", "mean", F.col("q")[0].alias("median"), "fold", F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"))  # a row each


def movie_shape(pixels: DataFrame) -> DataFrame:
    """movie_id, width, height, odd: more than 10 pixels off a square."""
    found = pixels.groupBy("movie_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return found.withColumn("odd", F.abs(F.col("height") - F.col("width")) > 10)


def crop_length(pixels: DataFrame, length: int) -> DataFrame:
    """Movies of at least length frames, cut to it."""
    long_ = pixels.groupBy("movie_id").agg(F.max("frame").alias("m")).where(F.col("m") + 1 >= length).select("movie_id")
    return pixels.where(F.col("frame") < length).join(long_, "movie_id", "left_semi")


def sample_boxes(candidates: DataFrame, movies: DataFrame, box: int, n: int, width: int, height: int, seed: int = 42) -> DataFrame:
    """movie_id, x, y: the first n boxes a movie that a walk over the candidates in a seeded order would take, skipping what overlaps a taken one.

    The walk is done in rounds over all movies at once: a candidate with the least key of all open candidates that it overlaps is taken
    whatever the others do, and closes those. The least key around a pixel is a minimum along rows and then along columns of the whole grid,
    so no pair of boxes is built and no movie meets in one task; rounds are few, as in any greedy choice in random order. candidates: distinct corners inside width x height.
    """
    key = order_key(seed, "box", F.col("movie_id"), F.col("x"), F.col("y"))
    grid = pixel_grid(movies, width, height).join(candidates.select("movie_id", "y", "x", F.lit(True).alias("open")), ["movie_id", "y", "x"], "left")
    now = cut(grid.select("movie_id", "y", "x", F.when(F.col("open"), key).alias("key"), F.lit(None).cast("string").alias("taken")))
    along = W.partitionBy("movie_id", "y").orderBy("x").rowsBetween(1 - box, box - 1)
    down = W.partitionBy("movie_id", "x").orderBy("y").rowsBetween(1 - box, box - 1)
    while now.where("key is not null").take(1):
        least = now.withColumn("least", F.min("key").over(along)).withColumn("least", F.min("least").over(down))
        first = least.withColumn("new", F.col("key") == F.col("least"))
        near = first.withColumn("near", F.max("new").over(down)).withColumn("near", F.max("near").over(along))
        now = cut(near.select("movie_id", "y", "x", F.when(~F.coalesce("near", F.lit(False)), F.col("key")).alias("key"), F.when(F.col("new"), F.col("key")).otherwise(F.col("taken")).alias("taken")))
    taken = now.where("taken is not null").withColumn("_r", F.row_number().over(W.partitionBy("movie_id").orderBy("taken")))
    return taken.where(F.col("_r") <= n).select("movie_id", "x", "y")
