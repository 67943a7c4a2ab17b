"""Seeded splits, folds, balancing and draws. Keys come from md5, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeded import order_key, uniform
from .ordered import running


def ranked(rows: DataFrame, within: list[str], id_: str, seed: int, salt: str) -> DataFrame:
    """rows, then _rank (from 1) and _n: a seeded order inside each group.

    Groups are first dealt to 64 shards by the key's leading digits; ranks are taken inside a shard
    and moved by the counts of the shards before, so a group of a third of all rows is no single task.
    """
    keyed = rows.withColumn("_key", order_key(seed, salt, F.col(id_))).withColumn("_shard", F.conv(F.substring("_key", 1, 2), 16, 10).cast("int"))
    counts = keyed.groupBy(*within, "_shard").agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*within).orderBy("_shard")
    before = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], F.col("_shard").alias("_s"), F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*within)).alias("_n"))
    inside = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(*within, "_shard").orderBy("_key", id_)))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)] + [F.col("_shard") == F.col("_s")]
    joined = inside.join(before, same)
    return joined.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_s", "_shard", "_before", "_key", *[f"_g{i}" for i in range(len(within))])


def stratified_split(rows: DataFrame, label: str, id_: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """rows, then split: each class cut at the rounded running shares; the last name takes the rest."""
    placed = ranked(rows, [label], id_, seed, "split")
    split, total = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        total += shares[name]
        test = F.col("_rank") <= F.round(F.lit(total) * F.col("_n"))
        split = F.when(test, name) if split is None else split.when(test, name)
    return placed.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[-1])).drop("_rank", "_n")


def stratified_folds(rows: DataFrame, label: str, id_: str, folds: int, seed: int = 42) -> DataFrame:
    """rows, then fold (from 1)."""
    return ranked(rows, [label], id_, seed, "fold").withColumn("fold", ((F.col("_rank") - 1) % folds + 1).cast("int")).drop("_rank", "_n")


def balance(rows: DataFrame, label: str, id_: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("_least"))
    return ranked(rows, [label], id_, seed, "balance").crossJoin(F.broadcast(least)).where(F.col("_rank") <= F.col("_least")).drop("_rank", "_n", "_least")


def cap(rows: DataFrame, label: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each class."""
    return ranked(rows, [label], id_, seed, "cap").where(F.col("_rank") <= n).drop("_rank", "_n")


def pick(rows: DataFrame, within: list[str], id_: str, n: int, seed: int = 42, salt: str = "pick") -> DataFrame:
    """n seeded rows of each group."""
    return ranked(rows, within, id_, seed, salt).where(F.col("_rank") <= n).drop("_rank", "_n")


def resample(rows: DataFrame, label: str, id_: str, draws: int, seed: int = 42) -> DataFrame:
    """draw, label, id: draws with replacement; classes equally likely, rows of a class too. An equi-join on (class number, rank)."""
    classes = rows.select(label).distinct()
    numbered = classes.withColumn("_class", F.row_number().over(W.orderBy(label)) - 1)  # one row a class
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).join(numbered, label).select("_class", F.col("_n"), F.col(label).alias("_label"))
    k = classes.agg(F.count(F.lit(1)).alias("_k"))
    drawn = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(k))
    drawn = drawn.withColumn("_class", F.floor(uniform(seed, "class", F.col("draw")) * F.col("_k")).cast("int"))
    drawn = drawn.join(F.broadcast(sizes), "_class").withColumn("_rank", (F.floor(uniform(seed, "member", F.col("draw")) * F.col("_n")) + 1).cast("long"))
    members = ranked(rows.select(label, id_), [label], id_, seed, "resample").select(F.col(label).alias("_l"), F.col(id_).alias("_i"), F.col("_rank").cast("long").alias("_r"))
    return drawn.join(members, (F.col("_label") == F.col("_l")) & (F.col("_rank") == F.col("_r"))).select("draw", F.col("_l").alias(label), F.col("_i").alias(id_))


def scramble(rows: DataFrame, label: str, id_: str, seed: int = 42) -> DataFrame:
    """rows, then scrambled: the labels permuted over all rows. Two sharded ranks, joined by ordinal; no global window over rows."""
    constant = F.lit(0).alias("_all")
    plain = ranked(rows.select("*", constant), ["_all"], id_, seed, "scramble/to").withColumnRenamed("_rank", "_to").drop("_n", "_all")
    other = ranked(rows.select(F.col(label).alias("scrambled"), F.col(id_).alias("_id"), constant), ["_all"], "_id", seed, "scramble/from").select("scrambled", F.col("_rank").alias("_from"))
    return plain.join(other, F.col("_to") == F.col("_from")).drop("_to", "_from")


def numbered(rows: DataFrame, within: str, order: list[str], name: str = "trace_id") -> DataFrame:
    """0-based numbers (long) in load order inside each group, by ranges of the order."""
    placed = running(rows.withColumn("_one", F.lit(1)), [within], list(order), {"_upto": "_one"})
    return placed.withColumn(name, F.col("_upto") - 1).drop("_one", "_upto", "all__upto")


def display_fold(seed: int, folds: int) -> Column:
    """A seeded fold number from 1 to folds."""
    return (F.floor(uniform(seed, "display") * folds) + 1).cast("int")
