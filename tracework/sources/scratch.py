"""Tables and files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one (spark.checkpoint.dir)."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-tracework-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder; a lost executor costs only its own tasks.

    The folder is spark.checkpoint.dir; where none is set on one machine (tests) a temporary one is used.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Written tables of an iteration; those that no later round reads are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def write(self, df: DataFrame) -> DataFrame:
        path = folder(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` tables."""
        jvm = self.spark.sparkContext._jvm
        for path in self.paths[: len(self.paths) - keep]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = self.paths[len(self.paths) - keep :]
