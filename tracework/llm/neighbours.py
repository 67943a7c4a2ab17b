"""Approximate nearest neighbours by cosine: NN-descent graph, greedy graph search.

Nodes. Equal vectors are one node, with its smallest ids (one more than can be
asked for), so a hot vector costs no more than any other. Vectors that are
null, zero, or hold null or non-finite components take no part; nor do vectors of another length
than most, which have no cosine with them.

Graph. Every node starts with links to the nearest of small blocks: two deals by signs of
seeded random projections and one by hash, so no node is left without links. A
round of NN-descent is a local join: a node's links and a seeded sample of the links to it
meet in one task, all pairs of them that hold a new link are scored, and each end learns of the other if that is nearer than
its farthest link. Rounds end once few links change. Vectors travel once a round, as 16-bit components.

Search. A query starts at the links of the node with its vector and, in every hop, expands
the nearest ``BEAM`` candidates that are not expanded yet, by a join with the graph; it ends when there are none or after ``HOPS``.
The candidates kept are scored on the original vectors in double precision, expanded into the nodes'
members, and ranked; ties go to the smaller id.

The widths are parameters of ``nearest`` (links, descents, stop, beam, hops), with the same defaults for all sizes; a wider beam finds more and
scores more. ``build_graph`` can report the links found after each round, so that recall
can be measured before and after each descent. Neighbours nearer to each other than 16-bit components tell apart are
kept or lost by chance where there are more than ``BEAM`` of them.

Defined cases: a query whose vector takes no part gives no rows; with fewer
candidates than asked for, all that the search reaches; repeated ids count
once; null ids take no part; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Rounds
from .common import groups, ranges, utf8, whole_groups, written

LINKS = 24
BACK = 24
BLOCK = 128
DEALS = 2
DESCENTS = 6
STOP = 0.1
BEAM = 160
HOPS = 6
SALTS = 64
GROUPS_AT_ONCE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(ok, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"), F.size(x).alias("dims"))
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.col("dims") == (most[0] if most else -1)).drop("dims")


def nodes_of(rows: DataFrame, members: int) -> DataFrame:
    """One row a distinct vector: node (its smallest id), embedding, members (its smallest ids), q (16-bit components), scaled (by its largest component, so squares neither vanish nor overflow) and the norm of that."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, members)
    salted = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(least(F.collect_set("vec_id")).alias("ids"))
    found = salted.groupBy("embedding").agg(least(F.flatten(F.collect_list("ids"))).alias("members"))

    def quantize(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                q = np.rint(x * 32767).astype(np.int16)
                more = [pa.array([v.tobytes() for v in q], pa.binary()), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.sqrt((x * x).sum(1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "q", "scaled", "norm"])

    rows = found.select(F.element_at("members", 1).alias("node"), "embedding", "members")
    return rows.mapInArrow(quantize, "node long, embedding array<double>, members array<long>, q binary, scaled array<double>, norm double")


def _unit(column) -> np.ndarray:
    """Unit float32 rows of a binary column."""
    x = np.ascontiguousarray(utf8(column)[0]).view(np.int16).reshape(len(column), -1).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def start_links(nodes: DataFrame, n: int, dims: int, links: int, seed: int = 42) -> DataFrame:
    """(v, w, sim): nearest neighbours within blocks of about BLOCK nodes, of DEALS deals by projections and one by hash."""
    bits = max(0, math.ceil(math.log2(max(n / BLOCK, 1))))
    planes = np.random.default_rng(seed).standard_normal((dims, DEALS * bits)).astype(np.float32)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            side = (_unit(batch.column("q")) @ planes > 0).reshape(batch.num_rows, DEALS, bits)
            code = (side.astype(np.int64) << np.arange(bits)).sum(2)
            for r in range(DEALS):
                yield pa.RecordBatch.from_arrays([pa.array(code[:, r] * (DEALS + 1) + r), batch.column("node"), batch.column("q")], ["block", "node", "q"])

    dealt = nodes.select("node", "q").mapInArrow(deal, "block long, node long, q binary")
    by_hash = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, math.ceil(n / BLOCK)))) * (DEALS + 1) + DEALS
    dealt = dealt.unionByName(nodes.select(by_hash.alias("block"), "node", "q"))
    parts = dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = dealt.join(parts, "block").withColumn("part", F.xxhash64("block", F.pmod(F.xxhash64("node", "block"), F.col("parts"))))

    def nearest(batches):
        for rows in groups(batches, "part"):
            ids, x = rows.column("node").to_numpy(), _unit(rows.column("q"))
            k = min(links, len(ids) - 1)
            if k:
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                columns = [pa.array(np.repeat(ids, k)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sim, top, 1).ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["v", "w", "sim"])

    return dealt.select("part", "node", "q").repartition("part").sortWithinPartitions("part").mapInArrow(nearest, "v long, w long, sim float")


def _nearest(pairs: DataFrame, links: int) -> DataFrame:
    """(v, w, sim, old) with repeats -> the links nearest ones of each v. One shuffle, by v."""
    best = pairs.repartition("v").groupBy("v", "w").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    top = best.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "w", "old")), False), 1, links).alias("top"))
    return top.select("v", F.explode("top").alias("t")).select("v", "t.w", "t.sim", "t.old")


def both_ways(graph: DataFrame, turn: int = 0) -> DataFrame:
    """(u, w, old): each node's links and a seeded sample of at most BACK links to it."""
    chosen = lambda c: F.slice(F.sort_array(c), 1, BACK)
    back = graph.select(F.col("w").alias("u"), F.struct(F.xxhash64("v", "w", F.lit(turn)).alias("h"), F.col("v").alias("w"), "old").alias("b"))
    # A hub's links are first thinned in parts.
    back = back.groupBy("u", F.pmod(F.col("b.h"), F.lit(SALTS)).alias("salt")).agg(chosen(F.collect_list("b")).alias("b"))
    back = back.groupBy("u").agg(chosen(F.flatten(F.collect_list("b"))).alias("b")).select("u", F.explode("b").alias("b")).select("u", "b.w", "b.old")
    return graph.select(F.col("v").alias("u"), "w", "old").unionByName(back)


def local_join(u: np.ndarray, w: np.ndarray, old: np.ndarray, far: np.ndarray, x: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole groups of u -> (v, w, sim): pairs of one group's w that aren't both old, where w is nearer than v's farthest link; the links nearest of each v."""
    head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    size = np.diff(np.append(head, len(u)))
    wide = int(size.max())
    row = np.where(np.arange(wide) < size[:, None], head[:, None] + np.arange(wide), -1)
    there = row >= 0
    y = x[row]
    sim = y @ y.transpose(0, 2, 1)
    ok = there[:, :, None] & there[:, None, :] & ~(old[row][:, :, None] & old[row][:, None, :]) & (w[row][:, :, None] != w[row][:, None, :])
    ok &= sim > far[row][:, :, None] + 1e-6
    g, i, j = np.nonzero(ok)
    v, other, sims = w[row[g, i]], w[row[g, j]], sim[g, i, j]
    by = np.lexsort((other, -sims, v))
    v, other, sims = v[by], other[by], sims[by]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (other[1:] != other[:-1])
    v, other, sims = v[new], other[new], sims[new]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    keep = ranges(np.diff(np.append(head, len(v)))) < links
    return v[keep], other[keep], sims[keep]


def _descend(links: int):
    def solve(rows: pa.RecordBatch):
        u, w, old, far = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("u", "w", "old", "far"))
        head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        size = np.diff(np.append(head, len(u)))
        own = np.repeat((size > 1) & ~np.logical_and.reduceat(old, head), size)  # groups without a new link have nothing to learn
        if not own.any():
            return
        x = _unit(rows.column("q"))[own]
        u, w, old, far = u[own], w[own], old[own], far[own]
        head = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u))
        for first in range(0, len(head) - 1, GROUPS_AT_ONCE):
            part = slice(head[first], head[min(first + GROUPS_AT_ONCE, len(head) - 1)])
            v, other, sim = local_join(u[part], w[part], old[part], far[part], x[part], links)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(other), pa.array(sim.astype(np.float32))], ["v", "w", "sim"])

    def run(batches):
        for rows in whole_groups(batches, "u"):
            yield from solve(rows)

    return run


def build_graph(nodes: DataFrame, n: int, dims: int, links: int = LINKS, report=None, descents: int = DESCENTS, stop: float = STOP) -> DataFrame:
    """(v, w, sim, old): each node's links. report: called with the graph before the first round and after each."""
    rounds = Rounds(nodes.sparkSession, "ann-graph")
    graph = rounds.write(_nearest(start_links(nodes, n, dims, links).withColumn("old", F.lit(False)), links))
    if report:
        report(graph)
    for turn in range(descents):
        ends = graph.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
        known = nodes.select("node", "q").join(ends, F.col("node") == F.col("v"), "left")
        known = known.select(F.col("node").alias("w"), "q", F.when(F.col("n") >= links, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("far"))
        met = both_ways(graph, turn).join(known, "w").repartition("u").sortWithinPartitions("u")
        found = met.select("u", "w", "old", "far", "q").mapInArrow(_descend(links), "v long, w long, sim float")
        every = graph.select("v", "w", "sim", F.lit(True).alias("old")).unionByName(found.withColumn("old", F.lit(False)))
        graph = rounds.write(_nearest(every, links))
        rounds.forget()
        if report:
            report(graph)
        if graph.where("not old").count() <= stop * links * n:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, hops: int = HOPS, beam_width: int = BEAM) -> DataFrame:
    """queries (query_id, node) -> query_id, w, sim: the candidates that greedy search keeps, the query's own node among them."""
    spark = nodes.sparkSession
    around = written(both_ways(graph).groupBy("u").agg(F.collect_set("w").alias("links")), "ann-around")
    own = written(queries.join(nodes.select("node", "q"), "node").select("query_id", "node", F.col("q").alias("x")), "ann-own")
    rounds = Rounds(spark, "ann-beam")
    beam = rounds.write(own.select("query_id", F.col("node").alias("w"), F.lit(2.0).cast("float").alias("sim"), F.lit(False).alias("done")))

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", _unit(batch.column("x")), _unit(batch.column("q")))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("w"), pa.array(sim)], ["query_id", "w", "sim"])

    for _ in range(hops):
        ahead = beam.where("not done").select("query_id", F.col("w").alias("u")).join(around, "u")
        met = ahead.select("query_id", F.explode("links").alias("w")).distinct().join(beam.select("query_id", "w"), ["query_id", "w"], "left_anti")
        met = met.join(nodes.select(F.col("node").alias("w"), "q"), "w").join(own.select("query_id", "x"), "query_id")
        found = met.select("query_id", "w", "x", "q").mapInArrow(score, "query_id long, w long, sim float")
        every = beam.withColumn("done", F.lit(True)).unionByName(found.withColumn("done", F.lit(False)))
        top = every.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "w", "done")), False), 1, beam_width).alias("top"))
        beam = rounds.write(top.select("query_id", F.explode("top").alias("t")).select("query_id", "t.w", "t.sim", "t.done"))
        rounds.forget()
        if not beam.where("not done").take(1):
            break
    return beam.select("query_id", "w", "sim")


def nearest(vectors: DataFrame, query_ids, k: int = 5, links: int = LINKS, descents: int = DESCENTS, stop: float = STOP, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; query_ids: a condition on vec_id.

    links a node in the graph; at most ``descents`` rounds, ended once fewer than the share ``stop`` of the links change; ``beam`` candidates kept a query and expanded for at most ``hops`` hops.
    """
    nodes = written(nodes_of(usable(vectors), k + 1), "ann-nodes")
    sizes = nodes.select(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    graph = build_graph(nodes, sizes[0], sizes[1] or 1, links, descents=descents, stop=stop)
    # the queries are rows, each at the node that has its vector
    rows = usable(vectors).where(query_ids(F.col("vec_id"))).select("vec_id", "embedding").distinct()
    at = nodes.select("node", "embedding", F.col("scaled").alias("x"), F.col("norm").alias("x_norm"))
    queries = written(rows.join(at, "embedding").select(F.col("vec_id").alias("query_id"), "node", "x", "x_norm"), "ann-queries")
    found = search(queries.select("query_id", "node"), nodes, graph, hops, beam)
    pairs = found.join(queries.select("query_id", "x", "x_norm"), "query_id").join(nodes.select(F.col("node").alias("w"), F.col("scaled").alias("y"), F.col("norm").alias("y_norm"), "members"), "w")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    scored = pairs.withColumn("score", dot / (F.col("x_norm") * F.col("y_norm")))
    each = scored.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
