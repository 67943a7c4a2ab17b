"""Sinks and their small companions: partitioned tables, manifests, CSV, JSON and checksums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

PARTITIONS = ("compound", "gt_label", "origin", "norm")


def write_traces(traces: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by compound, label, origin and normalisation; one shuffle keeps the number of files low without a task per hot partition."""
    traces.hint("rebalance", *PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """movie, attempt, traces: the movies that a resumable sink holds whole (traces may be 0)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/finished")
    kind = "movie string, attempt string, traces long"
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{path}/finished")


def write_resumable(traces: DataFrame, movies: DataFrame, path: str) -> int:
    """Writes the traces of the movies (movie) that the sink doesn't hold yet, and then says so; the number of movies written.

    Each attempt overwrites just the partitions it has rows for (a movie is the innermost one), so what a broken attempt left is replaced; rows carry their
    attempt, and a movie counts only with the attempt that its entry names, so what a broken attempt left elsewhere is never read. Entries follow
    the data, in one append. Running again, whatever came before, leaves every trace once.
    """
    spark, attempt = traces.sparkSession, uuid.uuid4().hex
    done = finished(spark, path).select("movie")
    todo = cut(movies.select(F.col("movie").cast("string")).distinct().join(done, "movie", "left_anti"))
    number = todo.count()
    if number:
        rows = traces.withColumn("movie", F.col("movie").cast("string")).join(todo, "movie", "left_semi").withColumn("attempt", F.lit(attempt))
        keys = [*PARTITIONS, "movie"]
        rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/traces")
        written = spark.read.schema(_stored_schema(rows)).parquet(f"{path}/traces").where(F.col("attempt") == attempt).groupBy("movie").agg(F.count(F.lit(1)).alias("n"))
        todo.join(written, "movie", "left").select("movie", F.lit(attempt).alias("attempt"), F.coalesce("n", F.lit(0)).cast("long").alias("traces")).write.mode("append").parquet(f"{path}/finished")
    return number


def _stored_schema(rows: DataFrame) -> T.StructType:
    keys = [*PARTITIONS, "movie"]
    return T.StructType([f for f in rows.schema.fields if f.name not in keys] + [rows.schema[k] for k in keys])


def read_resumable(spark: SparkSession, path: str) -> DataFrame:
    """The traces of finished movies, each once."""
    return spark.read.option("inferSchema", "false").parquet(f"{path}/traces").withColumn("movie", F.col("movie").cast("string")).join(finished(spark, path).select("movie", "attempt"), ["movie", "attempt"], "left_semi").drop("attempt")


def provenance(traces: DataFrame) -> DataFrame:
    """All but the values."""
    return traces.drop("values")


def status_table(outcomes: DataFrame) -> DataFrame:
    """movie, kind, status, n: succeeded, background and failed in one table."""
    return outcomes.groupBy("movie", "kind").agg(F.count("roi").alias("n")).withColumn("status", F.when(F.col("n") > 0, "succeeded").otherwise("failed"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """NaN becomes null."""
    clean = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*clean).write.mode("overwrite").json(path)


def checksums(spark: SparkSession, root: str, manifest: DataFrame, name: str = "([^/]*)$") -> DataFrame:
    """manifest (file, md5), then actual (NULL: missing) and ok. name: what of a path is its file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(F.regexp_extract("path", name, 1).alias("file"), F.md5("content").alias("actual"))
    return manifest.join(found, "file", "left").withColumn("ok", F.coalesce(F.col("actual") == F.col("md5"), F.lit(False)))


def parameters_used(resolved: DataFrame, run: str) -> DataFrame:
    """Rows for the params_used table of a run."""
    return resolved.withColumn("run", F.lit(run))
