"""The given tables seen as the engine's inputs. SQL texts run in DuckDB over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, class_idx, values: one row a trace."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("trace_id"), F.col("label").alias("class_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, class_idx, frame, intensity: one row a frame of a long trace."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "l_suppkey AS trace_id", "l_suppkey % 2 AS class_idx",
        "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INT) AS frame",
        "CAST(l_quantity AS DOUBLE) AS intensity",
    )


def long_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as arrays: trace_id, class_idx, values. One shuffle, by trace."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS trace_id", "struct(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS s")
    ordered = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("trace_id", (F.col("trace_id") % 2).alias("class_idx"), F.transform("s", lambda s: s["l_quantity"].cast("double")).alias("values"))


def localizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 8 AS movie_id", "datediff(l_shipdate, DATE '1995-01-01') AS frame", "((l_partkey*7919 + l_linenumber*31) % 2300)/CAST(10 AS DOUBLE) AS x",
        "((l_orderkey*104729) % 2300)/CAST(10 AS DOUBLE) AS y", "CAST(l_extendedprice AS DOUBLE) AS net_gradient",
    )


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey % 8 AS movie_id", "CAST(row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) - 1 AS INT) AS roi",
        "CAST(((c_custkey*7919) % 1013) % 220 AS INT) AS x", "CAST(((c_custkey*104729) % 1009) % 220 AS INT) AS y",
    )


def gt_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").selectExpr(
        "c_custkey % 8 AS movie_id", "CAST(((c_custkey*7919) % 1013) % 220 + c_custkey % 7 AS INT) AS x", "CAST(((c_custkey*104729) % 1009) % 220 + c_custkey % 3 AS INT) AS y",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 8 AS movie_id", "CAST(l_orderkey % 20 AS INT) AS frame", "CAST((l_partkey*31 + l_linenumber) % 230 AS INT) AS y", "CAST((l_orderkey*17 + l_suppkey) % 230 AS INT) AS x", "l_quantity AS q",
    )
    return rows.groupBy("movie_id", "frame", "y", "x").agg(F.sum("q").cast("long").alias("intensity"))


def movie_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    protein = "CASE o_custkey % 5 WHEN 0 THEN 'HaloD106' WHEN 1 THEN 'SNAPC148' WHEN 2 THEN 'HaloK117' WHEN 3 THEN 'scGrx1' ELSE 'scGrx1AcK20' END"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{protein} AS p", "CASE WHEN length(o_orderpriority) % 2 = 0 THEN '640' ELSE '488' END AS ch")
    return rows.selectExpr("concat('Exp', CAST(o_custkey % 3 + 1 AS STRING), '/', p, '/', p, '_', ch, 'nm_movie_', lpad(CAST(o_orderkey % 1000 AS STRING), 4, '0'), '.nd2') AS path")


def predictions_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, pass, prob1: twenty stochastic passes over each labelled document."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pass"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("sample_id").cast("string"), F.lit(":"), F.col("pass").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("prob1", F.least(F.lit(0.99), 0.2 + 0.3 * F.col("label") + 0.5 * u))


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_type AS model", "CAST(p_size % 3 AS INT) AS aug_factor", "CAST(p_partkey % 4 AS INT) + 1 AS fold", "CAST(p_retailprice AS DOUBLE) AS r", "CAST(p_size AS DOUBLE) AS s")
    return rows.groupBy("model", "aug_factor", "fold").agg((F.avg("r") / 1000).alias("auc"), F.avg("s").alias("bal_acc"))


def two_class_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").selectExpr("event_id", "event_type AS class_name", "CAST(value AS DOUBLE) AS value")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS run", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch", "value/500 AS val_auc", "1 - value/1000 AS val_loss",
    )


_U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"

#: CTEs for DuckDB, by name; each may use those before it.
SQL = {
    "traces": "SELECT vec_id AS trace_id, label AS class_idx, list_transform(embedding, lambda v: v::DOUBLE) AS values FROM embeddings",
    "tframes": "SELECT vec_id AS trace_id, label AS class_idx, generate_subscripts(embedding, 1) - 1 AS frame, unnest(embedding)::DOUBLE AS intensity FROM embeddings",
    "frames": "SELECT l_suppkey AS trace_id, l_suppkey % 2 AS class_idx, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INT) AS frame, CAST(l_quantity AS DOUBLE) AS intensity FROM lineitem",
    "localizations": "SELECT l_suppkey % 8 AS movie_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS frame, ((l_partkey*7919 + l_linenumber*31) % 2300)/CAST(10 AS DOUBLE) AS x, ((l_orderkey*104729) % 2300)/CAST(10 AS DOUBLE) AS y, CAST(l_extendedprice AS DOUBLE) AS net_gradient FROM lineitem",
    "rois": "SELECT c_custkey % 8 AS movie_id, CAST(row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) - 1 AS INT) AS roi, CAST(((c_custkey*7919) % 1013) % 220 AS INT) AS x, CAST(((c_custkey*104729) % 1009) % 220 AS INT) AS y FROM customer",
    "gt_spots": "SELECT c_custkey % 8 AS movie_id, CAST(((c_custkey*7919) % 1013) % 220 + c_custkey % 7 AS INT) AS x, CAST(((c_custkey*104729) % 1009) % 220 + c_custkey % 3 AS INT) AS y FROM customer WHERE c_custkey % 5 = 0",
    "pixels": "SELECT l_suppkey % 8 AS movie_id, CAST(l_orderkey % 20 AS INT) AS frame, CAST((l_partkey*31 + l_linenumber) % 230 AS INT) AS y, CAST((l_orderkey*17 + l_suppkey) % 230 AS INT) AS x, CAST(sum(l_quantity) AS BIGINT) AS intensity FROM lineitem GROUP BY 1, 2, 3, 4",
    "movie_paths": "SELECT concat('Exp', CAST(o_custkey % 3 + 1 AS VARCHAR), '/', p, '/', p, '_', ch, 'nm_movie_', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0'), '.nd2') AS path FROM (SELECT o_orderkey, o_custkey, CASE o_custkey % 5 WHEN 0 THEN 'HaloD106' WHEN 1 THEN 'SNAPC148' WHEN 2 THEN 'HaloK117' WHEN 3 THEN 'scGrx1' ELSE 'scGrx1AcK20' END AS p, CASE WHEN length(o_orderpriority) % 2 = 0 THEN '640' ELSE '488' END AS ch FROM orders) t",
    "predictions_mc": "SELECT doc_id AS sample_id, CAST(quality AS INT) AS label, pass, least(0.99::DOUBLE, 0.2::DOUBLE + 0.3::DOUBLE*quality + 0.5::DOUBLE*(" + _U.format("concat('7:', doc_id, ':', pass)") + ")) AS prob1 FROM labels, (SELECT unnest(range(20)) AS pass)",
    "fold_metrics": "SELECT p_type AS model, CAST(p_size % 3 AS INT) AS aug_factor, CAST(p_partkey % 4 AS INT) + 1 AS fold, avg(CAST(p_retailprice AS DOUBLE))/1000 AS auc, avg(CAST(p_size AS DOUBLE)) AS bal_acc FROM part GROUP BY 1, 2, 3",
    "two_class_values": "SELECT event_id, event_type AS class_name, CAST(value AS DOUBLE) AS value FROM events WHERE event_type IN ('click', 'view')",
    "epochs": "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch, value/500 AS val_auc, 1 - value/1000 AS val_loss FROM events",
}


def with_sql(*names: str, then: str) -> str:
    """A query over fixtures: WITH their CTEs, then the rest (which may begin with further CTEs)."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if not then.lstrip().upper().startswith("SELECT") else " ") + then
