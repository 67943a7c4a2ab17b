"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Targets. A source's weight follows its place in code-point order (null last),
by default 3, 1, 2 and again. The mix holds ``share`` of all words; a source's
target is ``least(cap, lambda * weight)`` with ``cap = most * size``: this is
what resharing the excess by weight, again and again, ends at.

Quotas. A block is ``block`` words, the same for every source. Sainte-Laguë
gives every block of the mix to the source with the highest quotient
``target / (2 q + 1)``, then every block of a source to its regions and of a region to its
shards in the same way, with their sizes as votes. A shard holds about ``SHARD_BLOCKS``
blocks and a region as many shards, so a hot source is spread over as many as it needs and no window
or join ever sees a whole source of documents (or of shards).

Selection. A shard's documents, in the order of a seeded hash, form one stream
of words that is cut into blocks. With quota q of n blocks, block k is taken
``C(k+1) - C(k)`` times, ``C(k) = floor((k q + phase) / n)``: a seeded
systematic sample, at most ``ceil(q / n)`` times each, which needs no sort of
blocks. A document's ``taken`` is the overlap of its words with taken blocks.

Defined cases: a null text has size 0; null sources form one source, last;
rows without a doc_id are told apart by their text; rows of one doc_id are
ordered by their text; rows equal in both share a shard and their order there;
an empty table gives an empty result; other columns stay after doc_id, source and text
(those that bear the name of a new column don't: the new ones win). A text is never held
outside its row, so its length only matters for the counting of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, hide, show, written

SHARD_BLOCKS = 4096
MOST_BLOCK = 256
BLOCKS_WANTED = 131072


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also weight, target. One row a source; see the module's text.

    The sources that are held at their cap are those with the smallest
    cap / weight, so prefix sums in that order give lambda without iterating.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_code) - 1, F.lit(n)) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onwards = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = (
        rows.withColumn("mix", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # The first row, in that order, which its own level does not fill; rows after it pass the test too.
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), (-F.col("level")).alias("level")))).over(everything)
    level = -first["level"]
    return rows.select("source", "source_size", "weight", "mix", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(votes: DataFrame, keys: list[str], by: list[str], seats, most=None) -> DataFrame:
    """votes: keys, by, votes (double) and what seats and most name -> keys, by, quota.

    Within each ``keys`` group, ``seats`` seats go to the highest quotients
    votes / (2 q + 1), ties to the smaller ``by``; ``most`` bounds a row's seats.
    Seats that surely belong to a row (the floor of its share, less a margin)
    need no ranking; the rest are ranked one by one.
    """
    group = W.partitionBy(*keys)
    rows = (
        votes.withColumn("_seats", seats.cast("long"))
        .withColumn("_most", (most if most is not None else F.col("_seats")).cast("long"))
        .withColumn("_all", F.sum("votes").over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_share", F.when(F.col("_all") > 0, F.col("votes") * F.col("_seats") / F.col("_all")).otherwise(0.0))
        # The divisor moves by at most n/2 seats in _seats, so a share moves by as large a part.
        .withColumn("_slack", F.ceil(F.col("_share") * F.col("_n") / (2 * F.greatest(F.col("_seats"), F.lit(1)))) + 2)
        .withColumn("_sure", F.least(F.greatest(F.floor("_share") - F.col("_slack"), F.lit(0)), F.col("_most")))
        .withColumn("_last", F.least(F.floor("_share") + F.col("_slack"), F.col("_most")))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    )
    names = [*keys, *by]
    ranked = (
        rows.where((F.col("_last") > F.col("_sure")) & (F.col("votes") > 0))
        .select(*names, "_open", "votes", F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1)).alias("_q"))
        .withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("votes") / (2 * F.col("_q") + 1)), *by, "_q")))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    base = rows.select(*names, "_sure").alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    return base.join(ranked.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in names], (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, ranges: bool = False, block: int | None = None) -> DataFrame:
    """Columns of docs, then size, source_size, target, taken (the words the mix takes, repeats counted).

    With ``ranges`` also ranges, array<struct<first, words, times>>: the document's
    parts of taken blocks, from its word ``first`` (0 is its first word), in order.
    ``block`` is the words a block; by default a ``BLOCKS_WANTED``th of all words, 1 at least and ``MOST_BLOCK`` at most.
    """
    new = ["size", "source_size", "target", "taken", *["ranges"] * ranges]
    rows, others = hide(docs, ["doc_id", "source", "text"], new)
    own = [f"c_{i}" for i in range(len(others))]
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    # Rows without a doc_id are told apart by their text.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), content.cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name))
    rows = rows.select("doc_id", "source", "text", *own, word_count().alias("size"), key.alias("key"), content.alias("content"))
    # One narrow row a document: sources and shards are added up from these, the texts are read once more only.
    narrow = written(rows.select("source", "key", "size"), "mixing-sizes")
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    wanted = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(F.sum("source_size").over(W.partitionBy()) / BLOCKS_WANTED)))
    sources = written(sources.withColumn("block", wanted.cast("long")), "mixing-sources")
    quotas = sainte_lague(
        sources.select(F.lit(1).alias("all"), "source", F.col("target").alias("votes"), F.round(F.col("mix") / F.col("block")).alias("blocks"), F.floor(F.lit(float(most)) * F.ceil(F.col("source_size") / F.col("block"))).alias("cap")),
        ["all"], ["source"], F.col("blocks"), F.col("cap"),
    ).select(F.col("source").alias("q_source"), F.col("quota").alias("source_quota"))
    # Written, so that Catalyst knows its size: it is broadcast only if that is small, and sources of any number are joined.
    sources = written(
        sources.join(quotas, F.col("source").eqNullSafe(F.col("q_source")), "left").select(
            F.col("source").alias("s_source"), "source_size", "target", "block", F.coalesce("source_quota", F.lit(0)).alias("source_quota"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * SHARD_BLOCKS))).cast("long").alias("shards"),
        ),
        "mixing-sources",
    )

    def deal(table: DataFrame) -> DataFrame:
        dealt = table.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        return dealt.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("shards")))

    shards = deal(narrow).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("source_quota").alias("source_quota"))
    # A source's blocks go to regions of SHARD_BLOCKS shards first, then a region's to its shards: no window holds a whole source's shards.
    shards = shards.withColumn("region", F.floor(F.col("shard") / SHARD_BLOCKS)).withColumn("cap", F.floor(F.lit(float(most)) * F.ceil(F.col("shard_size") / F.col("block"))))
    shards = written(shards, "mixing-shards")
    regions = shards.groupBy("source", "region").agg(F.sum("shard_size").cast("double").alias("votes"), F.sum("cap").alias("cap"), F.first("source_quota").alias("seats"))
    regions = sainte_lague(regions, ["source"], ["region"], F.col("seats"), F.col("cap")).select(F.col("source").alias("r_source"), F.col("region").alias("r_region"), F.col("quota").alias("seats"))
    inside = shards.join(regions, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("region") == F.col("r_region"))).withColumn("votes", F.col("shard_size").cast("double"))
    shard_quotas = sainte_lague(inside, ["source", "region"], ["shard"], F.col("seats"), F.col("cap")).select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "quota")
    in_shard = W.partitionBy("source", "shard")
    stream = (
        deal(rows).withColumn("end", F.sum("size").over(in_shard.orderBy("key", "doc_id", "content", "size").rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("n", F.ceil(F.sum("size").over(in_shard) / F.col("block")).cast("long"))
    )
    stream = stream.join(shard_quotas, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")), "left")
    phase = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:phase:"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n"))

    c = lambda j: F.floor((j * F.coalesce("quota", F.lit(0)) + phase) / F.col("n"))

    def upto(at):
        """Words taken of the stream's first ``at`` words."""
        k = F.floor(at / F.col("block"))
        return F.col("block") * c(k) + (at - k * F.col("block")) * (c(k + 1) - c(k))

    def parts():
        block, start, end = F.col("block"), F.col("end") - F.col("size"), F.col("end")
        part = lambda k: F.struct(
            (F.greatest(k * block, start) - start).alias("first"),
            (F.least((k + 1) * block, end) - F.greatest(k * block, start)).alias("words"),
            (c(k + 1) - c(k)).alias("times"),
        )
        blocks = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
        return F.when(F.col("size") > 0, F.filter(F.transform(blocks, part), lambda p: p["times"] > 0)).otherwise(F.array()).alias("ranges")

    taken = F.when(F.col("size") > 0, upto(F.col("end")) - upto(F.col("end") - F.col("size"))).otherwise(0).cast("long")
    lead = ["doc_id", "source", *(["text"] if "text" in docs.columns else [])]
    return show(stream, lead, others, ["size", "source_size", "target", taken.alias("taken"), *[parts()] * ranges])
