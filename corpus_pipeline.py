"""From raw documents to packed token sequences: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm import language_id, mixing, packing, simhash, suffix_dedup
from tracework.llm.common import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5
#: Near copies share this part of their distinct five-word shingles.
LEAST_RESEMBLANCE = 0.8
#: Where a word follows a separator.
_BEFORE_WORD = "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those whose language stays doubtful."""
    found = language_id.predict(docs.select(*COLUMNS), keep_text=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each component of near copies: SimHash fingerprints within a radius whose texts verify."""
    docs = docs.select(*COLUMNS)
    found = written(simhash.resembling_groups(docs.select("doc_id", "text"), LEAST_RESEMBLANCE), "near-found")
    said = found.select(F.col("doc_id").alias("f_id"), F.col("node").alias("f_node"), "rows", "keep")
    same = (simhash.text_node() == F.col("f_node")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
    stay = docs.join(said.where("not keep").hint("shuffle_hash"), same, "left_anti")
    repeated = said.where("keep and rows > 1")
    if not repeated.take(1):
        return stay
    # A kept (doc_id, text) that occurs again: one of its rows stays.
    once = stay.join(repeated, same).groupBy("f_id", "f_node").agg(*[F.first(c).alias(c) for c in COLUMNS]).select(*COLUMNS)
    return stay.join(repeated, same, "left_anti").unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated byte strings; a character that a cut splits goes too. Documents that are cut to nothing go."""
    cut = suffix_dedup.dedup(docs.select(*COLUMNS), keep=True)
    return cut.withColumn("text", F.col("kept_text")).where("length(text) > 0 or n_removed = 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's words that the mix takes: its copy k holds its words in the blocks taken k times or more, in their order."""
    taken = mixing.mix(docs.select(*COLUMNS), ranges=True).where("taken > 0")
    rows = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("ranges", lambda r: r["times"])))))
    rows = rows.withColumn("ranges", F.filter("ranges", lambda r: r["times"] >= F.col("copy")))
    rows = rows.withColumn("words", F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["words"]))
    skip = F.when(F.col("text").rlike("^[\\x20\\x09-\\x0D]"), 2).otherwise(1)
    # The outer transform binds the pieces, which else were split again for every range.
    cut = lambda pieces: F.flatten(F.transform("ranges", lambda r: F.slice(pieces, (r["first"] + skip).cast("int"), r["words"].cast("int"))))
    part = F.array_join(F.transform(F.array(F.split("text", _BEFORE_WORD)), cut)[0], "")
    rows = rows.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: None: tokens, language scores and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
