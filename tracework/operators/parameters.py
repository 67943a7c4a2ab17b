"""Extraction objective and the exhaustive sweep of gradient settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import spatial


def objective(single: Column, inside: Column, overlapping: Column, ground_truth: bool) -> Column:
    """single (1 + inside / max(single, 1)) (1 - overlap share) squared; without ground truth no inside factor; 0 when empty."""
    total = single + overlapping
    gain = 1 + inside / F.greatest(single, F.lit(1)) if ground_truth else F.lit(1.0)
    share = overlapping / total
    return F.when(total > 0, single * gain * (1 - share) * (1 - share)).otherwise(0.0)


def movie_objective(rois: DataFrame, keys: list[str], ground_truth: bool = True) -> DataFrame:
    """rois with overlap and ground_truth -> keys, n_single, n_in, n_overlapping, objective."""
    count = lambda c: F.sum(c.cast("long"))
    single = F.col("overlap") == "single"
    found = rois.groupBy(*keys).agg(count(single).alias("n_single"), count(single & (F.col("ground_truth") == "IN")).alias("n_in"), count(F.col("overlap") == "overlapping").alias("n_overlapping"))
    return found.withColumn("objective", objective(F.col("n_single"), F.col("n_in"), F.col("n_overlapping"), ground_truth))


def pooled(objectives: DataFrame, keys: list[str], part: str, how: str = "mean") -> DataFrame:
    """keys, pooled (mean or min over the parts), breakdown (map from part to objective)."""
    value = F.avg("objective") if how == "mean" else F.min("objective")
    return objectives.groupBy(*keys).agg(value.alias("pooled"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(part, "objective")))).alias("breakdown"))


def _level(gradients: list[float]) -> Column:
    """How many settings a net gradient reaches; settings ascend, so a localization is there at settings 1 to its level."""
    return F.size(F.filter(F.array(*[F.lit(g) for g in gradients]), lambda g: g <= F.col("net_gradient")))


def _hidden_by_level(boxes: DataFrame, box: int, settings: int, threshold: int, width: int, height: int) -> DataFrame:
    """movie_id, roi, o1, o2, ...: whether the box overlaps at each setting, by the painter's rule among the boxes there.

    A pixel's boxes are listed once with their levels. Of two of them the lower is next below the upper at the settings
    that both reach and no box between them does: a range, so pixels aren't repeated for settings.
    """
    cells = spatial.box_pixels(boxes, box, width, height).join(boxes.select("movie_id", "roi", "level"), ["movie_id", "roi"])
    stacks = cells.groupBy("movie_id", "px", "py").agg(F.array_sort(F.collect_list(F.struct("roi", "level"))).alias("b")).where(F.size("b") > 1)  # at most box * box corners

    def below(upper, i):
        zero = F.struct(F.lit(0).alias("top"), F.array().cast("array<struct<under:int,since:int,until:int>>").alias("found"))

        def look(s, lower):
            until = F.least(upper["level"], lower["level"])
            seen = F.concat(s["found"], F.array(F.struct(lower["roi"].alias("under"), (s["top"] + 1).alias("since"), until.alias("until"))))
            return F.struct(F.greatest(s["top"], lower["level"]).alias("top"), F.when(until > s["top"], seen).otherwise(s["found"]).alias("found"))

        return F.transform(F.aggregate(F.reverse(F.slice("b", F.lit(1), i)), zero, look)["found"], lambda p: F.struct(upper["roi"].alias("roi"), p["under"].alias("under"), p["since"].alias("since"), p["until"].alias("until")))

    pairs = stacks.select("movie_id", F.explode(F.flatten(F.transform("b", below))).alias("p")).select("movie_id", "p.*")
    at = range(1, settings + 1)
    shared = pairs.groupBy("movie_id", "roi", "under").agg(*[F.sum(((F.col("since") <= s) & (F.col("until") >= s)).cast("int")).alias(f"n{s}") for s in at])
    both = shared.select("movie_id", F.explode(F.array("roi", "under")).alias("roi"), *[(F.col(f"n{s}") > threshold).alias(f"o{s}") for s in at])
    return both.groupBy("movie_id", "roi").agg(*[F.max(f"o{s}").alias(f"o{s}") for s in at])


def grid_sweep(locs: DataFrame, spots: DataFrame, gradients: list[float], box: int, distance: float, width: int, height: int, threshold: int = 3, spot_gradients: list[float] | None = None) -> DataFrame:
    """gradient (and spot_gradient), movie_id and the objective of the boxes that localizations of each gradient or more give, labelled by the spots of each spot gradient or more.

    Settings are nested thresholds: a localization enters once, with the number of settings it reaches, and so do a box (of its strongest localization), a spot and the
    strongest spot near a box. Only boxes, not pixels or distances, are counted by setting, in one job for all of them. Without spot_gradients all spots count.
    """
    gradients, spot_gradients = sorted(float(g) for g in gradients), sorted(float(g) for g in spot_gradients or [])
    strong = locs.where(F.col("net_gradient") >= gradients[0]).withColumn("level", _level(gradients))
    boxes = strong.groupBy("movie_id", spatial.corner(F.col("x"), box).alias("x"), spatial.corner(F.col("y"), box).alias("y")).agg(F.max("level").alias("level"))
    boxes = cut(boxes.withColumn("roi", ((F.col("y") + box) * (width + 2 * box) + F.col("x") + box).cast("int") + 1))
    flagged = _hidden_by_level(boxes, box, len(gradients), threshold, width, height)
    own = spots.withColumn("spot_level", _level(spot_gradients) if spot_gradients else F.lit(1)).where("spot_level > 0").select("movie_id", "x", "y", "spot_level")
    near = spatial.pairs_within(boxes, own, distance, ["movie_id"]).groupBy("movie_id", F.col("l.roi").alias("roi")).agg(F.max("r.spot_level").alias("spot_level"))
    each = boxes.join(flagged, ["movie_id", "roi"], "left").join(near, ["movie_id", "roi"], "left")
    there = F.array(*[F.struct(F.lit(g).alias("gradient"), F.lit(s).alias("s"), F.coalesce(f"o{s}", F.lit(False)).alias("o")) for s, g in enumerate(gradients, 1)])
    rows = each.select("movie_id", F.coalesce("spot_level", F.lit(0)).alias("spot_level"), F.explode(F.filter(there, lambda t: t["s"] <= F.col("level"))).alias("t"))
    cube = rows.groupBy("movie_id", "t.gradient", "spot_level", "t.o").agg(F.count(F.lit(1)).alias("n"))  # a few rows a movie and setting
    limits = F.array(*[F.struct(F.lit(g).alias("spot_gradient"), F.lit(s).alias("s")) for s, g in enumerate(spot_gradients or [0.0], 1)])
    cube = cube.withColumn("g", F.explode(limits))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    keys = ["gradient", "spot_gradient", "movie_id"]
    found = cube.select("gradient", "g.spot_gradient", "movie_id", "o", "n", (F.col("spot_level") >= F.col("g.s")).alias("inside")).groupBy(*keys).agg(of(~F.col("o")).alias("n_single"), of(~F.col("o") & F.col("inside")).alias("n_in"), of(F.col("o")).alias("n_overlapping"))
    found = found.withColumn("objective", objective(F.col("n_single"), F.col("n_in"), F.col("n_overlapping"), True))
    return found if spot_gradients else found.drop("spot_gradient")


def best_setting(swept: DataFrame) -> DataFrame:
    """One row: gradient (and spot_gradient), pooled: the largest mean objective, the smallest gradients of equals."""
    keys = [c for c in ("gradient", "spot_gradient") if c in swept.columns]
    means = swept.groupBy(*keys).agg(F.avg("objective").alias("pooled"))
    best = means.agg(F.max_by(F.struct(*keys, "pooled"), F.struct(F.round("pooled", 12), *[(-F.col(k)).alias(f"_{k}") for k in keys])).alias("b"))
    return best.select(*[f"b.{k}" for k in keys], "b.pooled")
