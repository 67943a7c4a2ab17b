"""Movie catalog, channel pairing, parameters and scans. Paths are columns, so every step is a projection or a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _part(path: Column, back: int) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def list_paths(spark: SparkSession, root: str, suffix: str = ".nd2") -> DataFrame:
    """Paths below root, without reading contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return rows.where(F.lower("path").endswith(suffix))


def movie_catalog(paths: DataFrame, proteins: list[str] | None = None) -> DataFrame:
    """path, experiment, protein, file of .nd2 files (any case) three levels deep; hidden files and dirs are skipped."""
    p = F.col("path")
    rows = paths.select(p, _part(p, 3).alias("experiment"), _part(p, 2).alias("protein"), _part(p, 1).alias("file"))
    rows = rows.where(F.lower("file").endswith(".nd2") & ~F.col("file").startswith("._") & ~F.col("experiment").startswith("."))
    return rows.where(F.col("protein").isin(proteins)) if proteins else rows


def without_dirs(paths: DataFrame, excluded: list[str]) -> DataFrame:
    return paths.where(reduce(lambda a, b: a & b, [~F.col("path").contains(x) for x in excluded], F.lit(True)))


def rel_under(root: str, path: Column) -> Column:
    """The path relative to root; unchanged where it isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def discovery_summary(catalog: DataFrame) -> DataFrame:
    """protein (NULL: all), movies."""
    return catalog.rollup("protein").agg(F.count(F.lit(1)).alias("movies"))


def compound_match(path: Column, name: str) -> Column:
    """The file's name holds the compound, bounded by start or _ on the left and _ or - on the right."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in name)
    return F.regexp_extract(path, "([^/]*)$", 1).rlike(f"(^|_){quoted}[_-]")


def experiment_from_path(path: Column, run: str) -> Column:
    """The part after the run folder if two or more follow it; else the first part that begins with Exp or exp; else Unknown."""
    parts = F.split(path, "/")
    at = F.array_position(parts, run)
    after = F.when((at > 0) & (F.size(parts) - at >= 2), F.get(parts, at.cast("int")))
    named = F.get(F.filter(parts, lambda x: x.startswith("Exp") | x.startswith("exp")), F.lit(0))
    return F.coalesce(after, named, F.lit("Unknown"))


def pair_channels(paths: DataFrame, channel: str, gt_channel: str | None) -> DataFrame:
    """protein_path, gt_path: files of a directory with equal prefix (up to the first _) and number; of several partners the last path wins.

    Without a ground-truth channel gt_path is NULL.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    number = F.regexp_extract(name, "_(\\d{4})\\.[^.]*$", 1)
    rows = paths.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.substring_index(name, "_", 1).alias("prefix"), F.when(number == "", "NONE").otherwise(number).alias("num"), name.alias("name"))
    has = lambda c: F.col("name").contains(f"_{c}nm")
    left = rows.where(has(channel)).select("dir", "prefix", "num", F.col("path").alias("protein_path"))
    if gt_channel is None:
        return left.select("protein_path", F.lit(None).cast("string").alias("gt_path"))
    right = rows.where(has(gt_channel)).groupBy("dir", "prefix", "num").agg(F.max("path").alias("gt_path"))
    return left.join(right, ["dir", "prefix", "num"]).select("protein_path", "gt_path")


def unpaired(paths: DataFrame, channel: str, gt_channel: str) -> DataFrame:
    """Protein files without a partner."""
    mine = paths.where(F.regexp_extract("path", "([^/]*)$", 1).contains(f"_{channel}nm")).withColumnRenamed("path", "protein_path")
    return mine.join(pair_channels(paths, channel, gt_channel), "protein_path", "left_anti")


def finite_localizations(locs: DataFrame) -> DataFrame:
    """Rows whose x, y and frame are there and finite."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("x", "y", "frame")]
    return locs.where(reduce(lambda a, b: a & b, ok))


def tagged_scan(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A table with origin (the file it came from) and label."""
    return spark.read.parquet(path).withColumn("origin", F.col("_metadata.file_path")).withColumn("label", F.lit(label))


def class_slice(traces: DataFrame, compound: str, norm: str) -> DataFrame:
    """Partition-pruned slice, by equality; an error where it is empty. Mirrored series (names ending in _m) are left out."""
    rows = traces.where((F.col("compound") == compound) & (F.col("norm") == norm) & ~F.col("trace_name").endswith("_m"))
    if rows.isEmpty():
        raise ValueError(f"no traces of {compound} in {norm}")
    return rows


def next_run_number(runs: DataFrame, name: str = "run_name") -> DataFrame:
    """One row: next, 1 above the largest trailing number."""
    n = F.regexp_extract(name, "_(\\d+)$", 1)
    return runs.agg((F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).alias("next"))


def run_name(proteins: DataFrame, suffix: str) -> DataFrame:
    """One row: run_name, the sorted distinct proteins and a suffix."""
    return proteins.agg(F.concat(F.array_join(F.array_sort(F.collect_set("protein")), "_"), F.lit(f"_{suffix}")).alias("run_name"))


def resolve_parameters(pairs: DataFrame, by_experiment: DataFrame, by_protein: DataFrame, default: float) -> DataFrame:
    """experiment, protein, gradient, source: experiment's value, else the protein's, else the default."""
    rows = pairs.join(by_experiment.withColumnRenamed("gradient", "_e"), ["experiment", "protein"], "left").join(by_protein.withColumnRenamed("gradient", "_p"), "protein", "left")
    source = F.when(F.col("_e").isNotNull() | F.col("_p").isNotNull(), "optimized").otherwise("config_defaults")
    return rows.select("experiment", "protein", F.coalesce("_e", "_p", F.lit(float(default))).alias("gradient"), source.alias("source"))


def channel_of(path: Column, channels: dict[str, float]) -> Column:
    """The gradient of the channel that the file's name holds."""
    out = None
    for name, value in channels.items():
        test = F.regexp_extract(path, "([^/]*)$", 1).contains(f"_{name}nm")
        out = F.when(test, F.lit(float(value))) if out is None else out.when(test, F.lit(float(value)))
    return out


def choose_dataset(tables: dict[str, DataFrame] | None, use: str | None, single: DataFrame | None = None) -> DataFrame:
    """The table that use names; without tables or use, the single one. A name that isn't there is an error."""
    if tables is not None and use:
        if use not in tables:
            raise KeyError(f"no dataset named {use}")
        return tables[use]
    if single is None:
        raise KeyError("no dataset given")
    return single


def only(movies: DataFrame, experiment: str | None = None, protein: str | None = None) -> DataFrame:
    """Movies of one experiment and one protein, where given; an error if there are none."""
    for column, value in (("experiment", experiment), ("protein", protein)):
        if value is not None:
            movies = movies.where(F.col(column) == value)
            if movies.isEmpty():
                raise ValueError(f"no movies of {column} {value}")
    return movies


def split_by_ground_truth(traces: DataFrame, ground_truth: bool = True) -> DataFrame:
    """Traces of boxes that overlap no other, with subset: IN or OUT, or empty for all of them where there is no ground truth."""
    single = traces.where("overlap = 'single'")
    if not ground_truth:
        return single.withColumn("subset", F.lit(""))
    return single.where(F.col("ground_truth").isin("IN", "OUT")).withColumn("subset", F.col("ground_truth"))


def certainty_scan(spark: SparkSession, path: str, least: float) -> DataFrame:
    """Rows of a written certainty table (class_name, wd and more) with at least this distance; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("wd") >= least)
