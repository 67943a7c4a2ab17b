"""Running sums over a whole order without putting a group, or the table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str], deal: list[str | Column] | None = None) -> DataFrame:
    """rows, then for each name of sums the running sum of its column inside the keys, and all_<name>, the keys' whole sum.

    Rows are dealt by ranges of the order and written once with the number of their range, so all readers see the same
    ranges. Sums are taken inside a range and moved by the sums of the ranges before: the one window that sees a
    whole group has a row for each range. Ranges are found from a sample of the order's columns on the driver; ``deal`` names shorter ones that the order
    never goes against (say the beginnings of long texts), for rows that tie in them stay together.
    """
    dealt = cut(rows.repartitionByRange(*(deal or order)).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums],
        *[F.sum(f"_s_{name}").over(W.partitionBy(*keys)).alias(f"all_{name}") for name in sums],
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dealt.select("*", *[F.sum(c).over(inside).alias(f"_i_{name}") for name, c in sums.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    return summed.join(before, same).select(*rows.columns, *[(F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums], *[f"all_{name}" for name in sums])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n, q: the exact quantiles of a group's values, each between two neighbours by its share of the way; NULL and NaN are left out.

    Without keys an empty table gives one row of NULLs, as an aggregate does.

    Equal values are counted before they move, what remains is ranked by ranges of the value, and only the two values around
    each wanted rank are looked at: no task holds a group's values.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, keys, [*keys, "_v"], {"_upto": "_c"})
    place = lambda q: F.lit(float(q)) * (F.col("all__upto") - 1)
    wanted = F.array(*[F.struct(F.lit(2 * i + side).alias("i"), F.least(F.floor(place(q)) + side, F.col("all__upto") - 1).alias("rank")) for i, q in enumerate(shares) for side in (0, 1)])
    hits = placed.withColumn("_w", F.explode(F.filter(wanted, lambda w: (w["rank"] >= F.col("_upto") - F.col("_c")) & (w["rank"] < F.col("_upto")))))
    ends = hits.groupBy(*keys).agg(F.max("all__upto").alias("all__upto"), *[F.max(F.when(F.col("_w.i") == i, F.col("_v"))).alias(f"_e{i}") for i in range(2 * len(shares))])
    between = [F.col(f"_e{2 * i}") + (place(q) - F.floor(place(q))) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) for i, q in enumerate(shares)]
    return ends.select(*keys, F.col("all__upto").alias("n"), F.array(*between).alias("q"))
