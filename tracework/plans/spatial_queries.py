"""Queries over localizations, boxes and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parameters, spatial
from ..sources import fixtures as X
from ..sources.fixtures import with_sql
from .registry import query, rounded

BOX, SIDE = 7, 230
DISTANCE = 4.0

_CELLS = f"c AS (SELECT movie_id, roi, x + dx AS px, y + dy AS py FROM rois, (SELECT unnest(range({BOX})) AS dx), (SELECT unnest(range({BOX})) AS dy) WHERE x >= 0 AND y >= 0 AND x + dx < {SIDE} AND y + dy < {SIDE})"
_PAINT = _CELLS + ", u AS (SELECT *, lag(roi) OVER (PARTITION BY movie_id, px, py ORDER BY roi) AS under FROM c), s AS (SELECT movie_id, roi, under, count(*) AS n FROM u WHERE under IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, max(under) OVER (PARTITION BY movie_id, roi) AS hi FROM s), o AS (SELECT movie_id, roi FROM k WHERE n > 3 AND hi > 0 UNION SELECT movie_id, under FROM k WHERE n > 3 AND hi > 0)"


def background(spark, sf_dir):
    """Every third box stands for background, the others for protein."""
    return X.rois(spark, sf_dir).where("roi % 3 = 0"), X.rois(spark, sf_dir).where("roi % 3 <> 0")


@query(with_sql("pixels", then="SELECT movie_id, max(x) + 1 AS width, max(y) + 1 AS height, abs(max(y) - max(x)) > 10 AS odd FROM pixels GROUP BY 1"))
def a7_movie_shape(spark, sf_dir):
    return spatial.movie_shape(X.pixels(spark, sf_dir))


@query(with_sql("pixels", then="SELECT movie_id, count(*) AS pixels, max(frame) AS last FROM pixels p WHERE frame < 15 AND movie_id IN (SELECT movie_id FROM pixels GROUP BY 1 HAVING max(frame) + 1 >= 15) GROUP BY 1"))
def a8_movie_length(spark, sf_dir):
    return spatial.crop_length(X.pixels(spark, sf_dir), 15).groupBy("movie_id").agg(F.count(F.lit(1)).alias("pixels"), F.max("frame").alias("last"))


@query(with_sql("localizations", then="SELECT movie_id, count(*) AS n, round(avg(x), 6) AS x FROM localizations WHERE frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1"))
def a9_finite_localizations(spark, sf_dir):
    from ..sources.catalog import finite_localizations

    return rounded(finite_localizations(X.localizations(spark, sf_dir)).groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x")))


@query(with_sql("rois", "gt_spots", then=f"d AS (SELECT r.movie_id, r.roi, sqrt(min((r.x-g.x)*(r.x-g.x) + (r.y-g.y)*(r.y-g.y))) AS d FROM rois r LEFT JOIN gt_spots g USING (movie_id) GROUP BY 1, 2) SELECT movie_id, roi, round(CASE WHEN d < {DISTANCE} THEN d END, 6) AS nearest, CASE WHEN d < {DISTANCE} THEN 'IN' ELSE 'OUT' END AS ground_truth FROM d"))
def c2_nearest_label(spark, sf_dir):
    return rounded(spatial.label_by_nearest(X.rois(spark, sf_dir), X.gt_spots(spark, sf_dir), DISTANCE).select("movie_id", "roi", "nearest", "ground_truth"))


@query(with_sql("rois", then="SELECT movie_id, roi FROM rois b WHERE roi % 3 = 0 AND NOT EXISTS (SELECT 1 FROM rois p WHERE p.movie_id = b.movie_id AND p.roi % 3 <> 0 AND (p.x-b.x)*(p.x-b.x) + (p.y-b.y)*(p.y-b.y) <= 25)"))
def c3_background_buffer(spark, sf_dir):
    return spatial.background_buffer(*background(spark, sf_dir), 5.0).select("movie_id", "roi")


@query(with_sql("rois", then=_PAINT + " SELECT movie_id, roi FROM o"))
def c4_painter_overlap(spark, sf_dir):
    return spatial.painter_overlaps(X.rois(spark, sf_dir), BOX, 3, SIDE, SIDE)


@query(with_sql("rois", then=f"SELECT a.movie_id, a.roi AS a, b.roi AS b, greatest(0, {BOX} - abs(a.x-b.x)) * greatest(0, {BOX} - abs(a.y-b.y)) AS area FROM rois a JOIN rois b ON a.movie_id = b.movie_id AND a.roi < b.roi WHERE greatest(0, {BOX} - abs(a.x-b.x)) * greatest(0, {BOX} - abs(a.y-b.y)) > 3"))
def c4_pairwise_overlap(spark, sf_dir):
    return spatial.pairwise_overlaps(X.rois(spark, sf_dir), BOX, 3)


@query(with_sql("rois", "pixels", then=_CELLS + " SELECT p.movie_id, c.roi, p.frame, CAST(sum(p.intensity) AS BIGINT) AS intensity FROM pixels p JOIN c ON p.movie_id = c.movie_id AND p.x = c.px AND p.y = c.py GROUP BY 1, 2, 3"))
def c5_roi_sums(spark, sf_dir):
    return spatial.box_sums(X.pixels(spark, sf_dir), X.rois(spark, sf_dir), BOX, SIDE, SIDE)


@query(with_sql("rois", "pixels", then=_PAINT + ", v AS (SELECT p.movie_id, c.roi, sum(p.intensity) AS s FROM pixels p JOIN c ON p.movie_id = c.movie_id AND p.x = c.px AND p.y = c.py GROUP BY 1, 2) SELECT r.movie_id, r.roi, CASE WHEN o.roi IS NULL THEN 'single' ELSE 'overlapping' END AS overlap, CASE WHEN o.roi IS NULL THEN 20 ELSE 0 END AS frames, CASE WHEN o.roi IS NULL THEN coalesce(v.s, 0) ELSE 0 END::DOUBLE AS total FROM rois r LEFT JOIN o USING (movie_id, roi) LEFT JOIN v USING (movie_id, roi)"))
def j2_roi_traces(spark, sf_dir):
    from ..functions.arrays import total

    rois = X.rois(spark, sf_dir)
    rows = spatial.roi_traces(X.pixels(spark, sf_dir), rois, spatial.painter_overlaps(rois, BOX, 3, SIDE, SIDE), BOX, SIDE, SIDE)
    return rows.select("movie_id", "roi", "overlap", F.size("values").alias("frames"), total(F.col("values")).alias("total"))


def _numbered(locs):
    """Localizations with an id that doesn't depend on partitioning; equal ones have equal ids and stand for one."""
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    text = F.concat_ws(":", "movie_id", "frame", tenths("x"), tenths("y"), F.round(F.col("net_gradient") * 100).cast("long"))
    return locs.withColumn("id", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


_NUMBERED = "l AS (SELECT id, any_value(movie_id) AS movie_id, any_value(frame) AS frame, any_value(x) AS x, any_value(y) AS y FROM (SELECT *, CAST('0x' || substr(md5(concat_ws(':', movie_id, frame, CAST(round(x * 10) AS BIGINT), CAST(round(y * 10) AS BIGINT), CAST(round(net_gradient * 100) AS BIGINT))), 1, 15) AS BIGINT) AS id FROM localizations) GROUP BY 1)"
_REACH = "s AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(with_sql("localizations", then=_NUMBERED + """, k AS (SELECT p.id AS a, q.id AS b FROM (SELECT *, frame + unnest(range(1, 5)) AS later FROM l) p JOIN l q ON q.movie_id = p.movie_id AND q.frame = p.later WHERE (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) <= 4),
 """ + _REACH + """, m AS (SELECT l.*, least(l.id, coalesce(t.low, l.id)) AS molecule FROM l LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) t ON t.a = l.id)
 SELECT movie_id, molecule, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM m GROUP BY 1, 2""")))
def c6_link_localizations(spark, sf_dir):
    return rounded(spatial.link_localizations(_numbered(X.localizations(spark, sf_dir)), 2.0, 3))


@query(_recursive(with_sql("localizations", then=_NUMBERED + """, g AS (SELECT *, floor(x / 1.5) AS cx, floor(y / 1.5) AS cy FROM l),
 h AS (SELECT g.*, cx + dx AS nx, cy + dy AS ny FROM g, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
 near AS (SELECT g.id AS a, h.id AS b FROM g JOIN h ON g.movie_id = h.movie_id AND g.cx = h.nx AND g.cy = h.ny WHERE (g.x-h.x)*(g.x-h.x) + (g.y-h.y)*(g.y-h.y) <= 2.25),
 core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 3),
 k AS (SELECT a, b FROM near WHERE a < b AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 """ + _REACH + """, own AS (SELECT core.id, least(core.id, coalesce(t.low, core.id)) AS cluster FROM core LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) t ON t.a = core.id),
 m AS (SELECT near.a AS id, coalesce(any_value(mine.cluster), min(own.cluster)) AS cluster FROM near JOIN own ON own.id = near.b LEFT JOIN own mine ON mine.id = near.a GROUP BY 1)
 SELECT movie_id, cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM l JOIN m USING (id) GROUP BY 1, 2""")))
def c7_density_clusters(spark, sf_dir):
    return rounded(spatial.density_clusters(_numbered(X.localizations(spark, sf_dir)), 1.5, 3))


EDGE = 10
_FREE = _CELLS + f""", q AS (SELECT DISTINCT movie_id, px - dx AS x, py - dy AS y FROM c, (SELECT unnest(range({BOX})) AS dx), (SELECT unnest(range({BOX})) AS dy)),
 g AS (SELECT movie_id, x, y FROM (SELECT DISTINCT movie_id FROM rois) m, (SELECT unnest(range({EDGE}, {SIDE - BOX - EDGE})) AS x), (SELECT unnest(range({EDGE}, {SIDE - BOX - EDGE})) AS y)),
 free AS (SELECT movie_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM g ANTI JOIN q USING (movie_id, x, y))"""


def _free(spark, sf_dir):
    rois = X.rois(spark, sf_dir)
    taken = spatial.box_pixels(rois, BOX, SIDE, SIDE).select("movie_id", F.col("px").alias("x"), F.col("py").alias("y"))
    return spatial.free_boxes(taken, rois, BOX, SIDE, SIDE, EDGE)


@query(with_sql("rois", then=_FREE + " SELECT * FROM free"))
def c10_free_boxes(spark, sf_dir):
    return _free(spark, sf_dir)


# The walk itself: each step of the recursion takes a movie's least open candidate and drops what it overlaps.
@query(_recursive(with_sql("rois", then=_FREE + f""", w AS (SELECT 0 AS step, *, first_value(x) OVER o AS tx, first_value(y) OVER o AS ty FROM (SELECT *, md5(concat('42:box:', movie_id, ':', x, ':', y)) AS key FROM free) WINDOW o AS (PARTITION BY movie_id ORDER BY key)
 UNION ALL SELECT step + 1, movie_id, x, y, key, first_value(x) OVER o, first_value(y) OVER o FROM w WHERE step < 39 AND (abs(x - tx) >= {BOX} OR abs(y - ty) >= {BOX}) WINDOW o AS (PARTITION BY movie_id ORDER BY key))
 SELECT DISTINCT movie_id, tx AS x, ty AS y FROM w""")))
def f9_background_positions(spark, sf_dir):
    return spatial.sample_boxes(_free(spark, sf_dir), X.rois(spark, sf_dir), BOX, 40, SIDE, SIDE)


@query(with_sql("pixels", then="SELECT movie_id, y, x, max(intensity) AS intensity FROM pixels GROUP BY 1, 2, 3"))
def d1_max_projection(spark, sf_dir):
    return spatial.max_projection(X.pixels(spark, sf_dir))


@query(with_sql("pixels", "rois", then=_CELLS + " SELECT p.movie_id, c.roi, p.frame, CAST(sum(p.intensity) AS BIGINT) AS intensity FROM pixels p JOIN c ON p.movie_id = c.movie_id AND p.x = c.px AND p.y = c.py WHERE c.roi % 3 = 0 GROUP BY 1, 2, 3"))
def d2_background_sums(spark, sf_dir):
    return spatial.box_sums(X.pixels(spark, sf_dir), background(spark, sf_dir)[0], BOX, SIDE, SIDE)


_SPOTS = f"b AS (SELECT movie_id, row_number() OVER (PARTITION BY movie_id ORDER BY x, y) AS roi, x, y FROM gt_spots WHERE x + {BOX} <= {SIDE} AND y + {BOX} <= {SIDE}), v AS (SELECT b.movie_id, roi, sum(p.intensity) AS s FROM b JOIN pixels p ON p.movie_id = b.movie_id AND p.frame < 10 AND p.x BETWEEN b.x AND b.x + {BOX - 1} AND p.y BETWEEN b.y AND b.y + {BOX - 1} GROUP BY 1, 2)"


@query(with_sql("pixels", "gt_spots", then=_SPOTS + " SELECT count(*) AS n, CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6)::DOUBLE AS median, round(max(s) * 1.0::DOUBLE / min(s), 6) AS fold, round(quantile_cont(s, 0.1), 6)::DOUBLE AS p10, round(quantile_cont(s, 0.9), 6)::DOUBLE AS p90 FROM v"))
def d20_spot_intensities(spark, sf_dir):
    from pyspark.sql import Window as W

    spots = X.gt_spots(spark, sf_dir).withColumn("roi", F.row_number().over(W.partitionBy("movie_id").orderBy("x", "y")))
    return rounded(spatial.spot_intensities(X.pixels(spark, sf_dir), spots, BOX, SIDE, SIDE))


@query(with_sql("rois", then=_PAINT + " SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o.roi IS NULL THEN 'single' ELSE 'overlapping' END AS kind FROM rois r LEFT JOIN o ON r.movie_id = o.movie_id AND r.roi = o.roi UNION ALL SELECT 'background' FROM rois WHERE roi % 3 = 0) GROUP BY 1"))
def d26_roi_counts(spark, sf_dir):
    rois = X.rois(spark, sf_dir)
    flagged = rois.join(spatial.painter_overlaps(rois, BOX, 3, SIDE, SIDE).withColumn("o", F.lit(True)), ["movie_id", "roi"], "left")
    kinds = flagged.select(F.when(F.col("o"), "overlapping").otherwise("single").alias("kind")).unionByName(background(spark, sf_dir)[0].select(F.lit("background").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("rois", then=_PAINT + " SELECT movie_id, roi FROM rois EXCEPT SELECT movie_id, roi FROM o"))
def g2_except_overlapping(spark, sf_dir):
    rois = X.rois(spark, sf_dir)
    return rois.select("movie_id", "roi").join(spatial.painter_overlaps(rois, BOX, 3, SIDE, SIDE), ["movie_id", "roi"], "left_anti")


@query(with_sql("pixels", then="p AS (SELECT movie_id, y, x, max(intensity) AS v FROM pixels GROUP BY 1, 2, 3), e AS (SELECT movie_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM p GROUP BY 1) SELECT movie_id, y, x, v AS intensity, round(0.5 * greatest(0, least(1, (v - a) / CASE WHEN b > a THEN b - a ELSE 1 END)), 6) AS value FROM p JOIN e USING (movie_id)"))
def h20_contrast(spark, sf_dir):
    return rounded(spatial.contrast(spatial.max_projection(X.pixels(spark, sf_dir)), weight=0.5))


@query(with_sql("localizations", then="SELECT movie_id, CAST(round_even(x - 3.5, 0) AS INT) AS bx, CAST(round_even(y - 3.5, 0) AS INT) AS \"by\", count(*) AS n FROM localizations GROUP BY 1, 2, 3"))
def h21_box_corner(spark, sf_dir):
    rows = X.localizations(spark, sf_dir).select("movie_id", spatial.corner(F.col("x"), BOX).alias("bx"), spatial.corner(F.col("y"), BOX).alias("by"))
    return rows.groupBy("movie_id", "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def labelled_rois(spark, sf_dir):
    rois = X.rois(spark, sf_dir)
    near = spatial.label_by_nearest(rois, X.gt_spots(spark, sf_dir), DISTANCE)
    flags = spatial.painter_overlaps(rois, BOX, 3, SIDE, SIDE).withColumn("o", F.lit(True))
    return near.join(flags, ["movie_id", "roi"], "left").withColumn("overlap", F.when(F.col("o"), "overlapping").otherwise("single"))


_OBJECTIVE = _PAINT + f", d AS (SELECT r.movie_id, r.roi, coalesce(min((r.x-g.x)*(r.x-g.x) + (r.y-g.y)*(r.y-g.y)) < {DISTANCE * DISTANCE}, false) AS inside FROM rois r LEFT JOIN gt_spots g USING (movie_id) GROUP BY 1, 2), z AS (SELECT d.movie_id, count(*) FILTER (WHERE o.roi IS NULL) AS ns, count(*) FILTER (WHERE o.roi IS NULL AND inside) AS ni, count(*) FILTER (WHERE o.roi IS NOT NULL) AS no FROM d LEFT JOIN o ON d.movie_id = o.movie_id AND d.roi = o.roi GROUP BY 1), y AS (SELECT *, ns * (1 + ni * 1.0::DOUBLE / greatest(ns, 1)) * (1 - no * 1.0::DOUBLE / (ns + no)) * (1 - no * 1.0::DOUBLE / (ns + no)) AS objective FROM z)"


@query(with_sql("rois", "gt_spots", then=_OBJECTIVE + " SELECT movie_id, ns AS n_single, ni AS n_in, no AS n_overlapping, round(objective, 6) AS objective FROM y"))
def d18_objective(spark, sf_dir):
    return rounded(parameters.movie_objective(labelled_rois(spark, sf_dir), ["movie_id"]))


@query(with_sql("rois", "gt_spots", then=_OBJECTIVE + " SELECT movie_id % 2 AS part, round(avg(objective), 6) AS pooled, CAST(count(*) AS INT) AS parts FROM y GROUP BY 1"))
def d19_pooled_objective(spark, sf_dir):
    rows = parameters.movie_objective(labelled_rois(spark, sf_dir), ["movie_id"]).withColumn("part", F.col("movie_id") % 2)
    return rounded(parameters.pooled(rows, ["part"], "movie_id").select("part", "pooled", F.size("breakdown").alias("parts")))


_SWEEP = f"""s AS (SELECT unnest([20000.0, 40000.0, 60000.0, 80000.0])::DOUBLE AS gradient),
 b AS (SELECT *, (y + {BOX}) * {SIDE + 2 * BOX} + x + {BOX} + 1 AS roi FROM (SELECT DISTINCT gradient, movie_id, CAST(round_even(x - 3.5, 0) AS INT) AS x, CAST(round_even(y - 3.5, 0) AS INT) AS y FROM localizations, s WHERE net_gradient >= gradient AND x IS NOT NULL)),
 c AS (SELECT gradient, movie_id, roi, x + dx AS px, y + dy AS py FROM b, (SELECT unnest(range({BOX})) AS dx), (SELECT unnest(range({BOX})) AS dy) WHERE x >= 0 AND y >= 0 AND x + dx < {SIDE} AND y + dy < {SIDE}),
 u AS (SELECT *, lag(roi) OVER (PARTITION BY gradient, movie_id, px, py ORDER BY roi) AS under FROM c), k AS (SELECT gradient, movie_id, roi, under, count(*) AS n FROM u WHERE under IS NOT NULL GROUP BY 1, 2, 3, 4),
 o AS (SELECT gradient, movie_id, roi FROM k WHERE n > 3 UNION SELECT gradient, movie_id, under FROM k WHERE n > 3),
 d AS (SELECT gradient, movie_id, roi, coalesce(min((b.x-g.x)*(b.x-g.x) + (b.y-g.y)*(b.y-g.y)) < {DISTANCE * DISTANCE}, false) AS inside FROM b LEFT JOIN gt_spots g USING (movie_id) GROUP BY 1, 2, 3),
 z AS (SELECT d.gradient, d.movie_id, count(*) FILTER (WHERE o.roi IS NULL) AS n_single, count(*) FILTER (WHERE o.roi IS NULL AND inside) AS n_in, count(*) FILTER (WHERE o.roi IS NOT NULL) AS n_overlapping FROM d LEFT JOIN o ON d.gradient = o.gradient AND d.movie_id = o.movie_id AND d.roi = o.roi GROUP BY 1, 2)
 SELECT *, round(n_single * (1 + n_in * 1.0::DOUBLE / greatest(n_single, 1)) * (1 - n_overlapping * 1.0::DOUBLE / (n_single + n_overlapping)) * (1 - n_overlapping * 1.0::DOUBLE / (n_single + n_overlapping)), 6) AS objective FROM z"""


@query(with_sql("localizations", "gt_spots", then=_SWEEP))
def j10_gradient_sweep(spark, sf_dir):
    locs = X.localizations(spark, sf_dir).withColumn("x", F.col("x")).where("x is not null")
    return rounded(parameters.grid_sweep(locs, X.gt_spots(spark, sf_dir), [float(g) for g in range(20000, 100000, 20000)], BOX, DISTANCE, SIDE, SIDE))


# The same sweep with spots of a gradient of their own, every pair of settings taken by itself.
_SPOT_LOCS = "gl AS (SELECT c_custkey % 8 AS movie_id, CAST(((c_custkey*7919) % 1013) % 220 + c_custkey % 7 AS INT) AS x, CAST(((c_custkey*104729) % 1009) % 220 + c_custkey % 3 AS INT) AS y, (1 + (c_custkey * 37) % 10) * 1000.0::DOUBLE AS net_gradient FROM customer), sg AS (SELECT unnest([1000.0, 4000.0, 8000.0])::DOUBLE AS spot_gradient), "
_TWO = _SPOT_LOCS + _SWEEP.replace(
    f"d AS (SELECT gradient, movie_id, roi, coalesce(min((b.x-g.x)*(b.x-g.x) + (b.y-g.y)*(b.y-g.y)) < {DISTANCE * DISTANCE}, false) AS inside FROM b LEFT JOIN gt_spots g USING (movie_id) GROUP BY 1, 2, 3)",
    f"d AS (SELECT gradient, spot_gradient, b.movie_id, roi, coalesce(min((b.x-g.x)*(b.x-g.x) + (b.y-g.y)*(b.y-g.y)) < {DISTANCE * DISTANCE}, false) AS inside FROM b CROSS JOIN sg LEFT JOIN gl g ON g.movie_id = b.movie_id AND g.net_gradient >= spot_gradient GROUP BY 1, 2, 3, 4)",
).replace("SELECT d.gradient, d.movie_id, count(*)", "SELECT d.gradient, d.spot_gradient, d.movie_id, count(*)").replace("d.roi = o.roi GROUP BY 1, 2)", "d.roi = o.roi GROUP BY 1, 2, 3)")


def spot_localizations(spark, sf_dir):
    """Localizations of the ground-truth channel, with net gradients."""
    return X.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey % 8 AS movie_id", "CAST(((c_custkey*7919) % 1013) % 220 + c_custkey % 7 AS INT) AS x", "CAST(((c_custkey*104729) % 1009) % 220 + c_custkey % 3 AS INT) AS y", "CAST((1 + (c_custkey * 37) % 10) * 1000 AS DOUBLE) AS net_gradient",
    )


def _two_gradients(spark, sf_dir):
    locs = X.localizations(spark, sf_dir).where("x is not null")
    return parameters.grid_sweep(locs, spot_localizations(spark, sf_dir), [float(g) for g in range(20000, 100000, 20000)], BOX, DISTANCE, SIDE, SIDE, spot_gradients=[1000.0, 4000.0, 8000.0])


@query(with_sql("localizations", then=_TWO))
def j10_two_gradient_sweep(spark, sf_dir):
    return rounded(_two_gradients(spark, sf_dir))


@query(with_sql("localizations", then=_TWO.replace(" SELECT *, round(n_single", ", w AS (SELECT *, round(n_single") + "), m AS (SELECT gradient, spot_gradient, avg(objective) AS pooled FROM w GROUP BY 1, 2) SELECT gradient, spot_gradient, round(pooled, 4) AS pooled FROM m ORDER BY round(pooled, 9) DESC, gradient, spot_gradient LIMIT 1"))
def j10_best_setting(spark, sf_dir):
    return rounded(parameters.best_setting(_two_gradients(spark, sf_dir)), 4)
