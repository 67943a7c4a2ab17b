"""Connected components of a link table by alternating large-star and small-star joins.

Links are first contracted inside every task by a union-find over one batch
(a map-side combine), which shortens long chains. A round changes the links of nodes
that have smaller and larger neighbours, or several smaller ones; only those are dealt
to several tasks, and without any the links are stars and the work is done. Each round is
written to the shared folder, so the lineage stays one round deep. At most a row reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Rounds

#: A node of many links is dealt to so many tasks in the joins.
SALTS = 8
#: Links that stand together and are contracted at once; bounds a task's memory.
TOGETHER = 200_000


def smallest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that each of them reaches by the links x[i]-y[i], by min-label hooking and jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) for the links a[i]-b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[smallest(len(nodes), at[: len(a)], at[len(a) :])]


def _contract(batches):
    for batch in batches:
        if batch.num_rows:
            nodes, root = roots_of(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            ok = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[ok]), pa.array(root[ok])], ["a", "b"])


def contracted(links: DataFrame, near: str) -> DataFrame:
    """(a, b) links -> (node, root) for every run of links: its nodes with the smallest that each reaches in the run.

    Links of equal ``near`` stand together, TOGETHER links make a run, so a node comes once for each run that has it.
    """

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                yield solve(held)
                held, n = [], 0
        if n:
            yield solve(held)

    def solve(held):
        rows = pa.concat_batches(held)
        nodes, root = roots_of(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    dealt = links.select(near, F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").repartition(near).sortWithinPartitions(near)
    return dealt.select("a", "b").mapInArrow(run, "node long, root long")


def salted(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with table (one row for each value of keys), a key's rows over SALTS tasks by their column ``by``."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, [*keys, "salt"], how).drop("salt")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a long, b long) links -> (node, root): each linked node that isn't its component's smallest, with that smallest.

    Null ends and self-links are dropped, repeats don't matter; an empty table gives an empty result.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    rounds = Rounds(links.sparkSession, name)
    now = rounds.write(pairs.mapInArrow(_contract, "a long, b long").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sides = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b") < F.col("a")).alias("smaller"))
        between = (F.col("low") < F.col("a")) & (F.col("high") > F.col("a"))
        if not sides.where(between | (F.col("smaller") > 1)).take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # Large star: every node's larger neighbours are linked to its smallest neighbour (or itself); only nodes between others change links.
        low = sides.where(between).select("a", "low")
        large = salted(now.select(F.col("b").alias("a"), F.col("a").alias("b")), low, ["a"], "b", "left")
        large = rounds.write(large.select(F.col("b").alias("a"), F.coalesce("low", "a").alias("b")).distinct())
        # Small star: a node's smaller neighbours, and itself, are linked to the smallest of them; one alone stays as it is.
        down = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "low")
        small = salted(large, down, ["a"], "b", "left").withColumn("low", F.coalesce("low", "b"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("p")).select("p.*").where("a <> b")
        now = rounds.write(small.mapInArrow(_contract, "a long, b long").distinct())
        rounds.forget()
