"""Sums of boxes, against sums pixel by pixel."""

import random

import pytest
from pyspark.sql import functions as F

from tracework.operators import spatial


@pytest.mark.parametrize("kind", ["long", "double"])
def test_box_sums_equal_plain_ones(spark, kind):
    """Boxes over the sides and with negative corners, repeated pixels, missing values and frames, pixels outside, one box in two places."""
    rng = random.Random(len(kind))
    number = int if kind == "long" else float
    pixels = [(rng.choice([1, 1, 2, None]), rng.choice([0, 3, 7, None]), rng.randint(-1, 13), rng.randint(-1, 10), rng.choice([None, *map(number, range(-3, 9))])) for _ in range(150)]
    pixels += pixels[:20] + [(1, 3, None, 4, number(5)), (3, 1, 2, 2, None)]
    rois = [(rng.choice([1, 2, 3]), i, rng.randint(-2, 13), rng.randint(-2, 10)) for i in range(60)] + [(1, 5, 4, 4), (3, 90, 1, 1), (1, 91, None, 3)]
    want = {}
    for movie, roi, x, y in rois:
        if x is None or x < 0 or y < 0:
            continue
        for m, frame, py, px, v in pixels:
            if m == movie and py is not None and x <= px < min(x + 3, 10) and y <= py < min(y + 3, 12):
                old = want.get((m, roi, frame))
                want[m, roi, frame] = old if v is None else v + (old or 0)
    df = spark.createDataFrame(pixels, f"movie_id long, frame int, y int, x int, intensity {kind}")
    found = spatial.box_sums(df, spark.createDataFrame(rois, "movie_id long, roi int, x int, y int"), 3, 10, 12)
    got = [tuple(r) for r in found.select("movie_id", "roi", "frame", "intensity").collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    assert spatial.box_sums(df.where("false"), spark.createDataFrame(rois, "movie_id long, roi int, x int, y int"), 3, 10, 12).collect() == []


def test_boxes_over_one_place_are_looked_up(spark):
    """A thousand boxes on one corner join a row for each box and frame, not one for each of their pixels."""
    pixels = spark.range(400).select(F.lit(1).alias("movie_id"), F.lit(0).alias("frame"), (F.col("id") % 20).cast("int").alias("y"), (F.col("id") / 20).cast("int").alias("x"), F.lit(1).cast("long").alias("intensity"))
    rois = spark.range(1000).select(F.lit(1).alias("movie_id"), F.col("id").cast("int").alias("roi"), F.lit(5).alias("x"), F.lit(5).alias("y"))
    found = spatial.box_sums(pixels, rois, 7, 20, 20)
    assert {(r.roi, r.intensity) for r in found.collect()} == {(i, 49) for i in range(1000)}
    assert "explode" not in found._jdf.queryExecution().toString()
