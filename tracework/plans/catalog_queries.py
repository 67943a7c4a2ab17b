"""Queries over paths, pairs, parameters and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import certainty, stats
from ..sources import catalog, scratch, sinks
from ..sources import fixtures as X
from ..sources.fixtures import with_sql
from .metric_queries import _WD, long_passes
from .registry import query, rounded
from .spatial_queries import _PAINT, DISTANCE, labelled_rois


@query(with_sql("movie_paths", then="SELECT experiment, protein, count(*) AS files FROM (SELECT split_part(path, '/', 1) AS experiment, split_part(path, '/', 2) AS protein FROM movie_paths) WHERE protein IN ('HaloD106', 'SNAPC148') GROUP BY 1, 2"))
def a1_movie_catalog(spark, sf_dir):
    return catalog.movie_catalog(X.movie_paths(spark, sf_dir), ["HaloD106", "SNAPC148"]).groupBy("experiment", "protein").agg(F.count(F.lit(1)).alias("files"))


@query(with_sql("movie_paths", then="SELECT split_part(path, '/', 1) AS experiment, count(*) AS n FROM movie_paths WHERE path NOT LIKE '%Exp2%' AND path NOT LIKE '%/HaloK117/%' GROUP BY 1"))
def a2_excluded_dirs(spark, sf_dir):
    rows = catalog.without_dirs(X.movie_paths(spark, sf_dir), ["Exp2", "/HaloK117/"])
    return rows.groupBy(F.split("path", "/")[0].alias("experiment")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("movie_paths", then="SELECT CASE WHEN path LIKE 'Exp1/%' THEN substr(path, 6) ELSE path END AS rel, count(*) AS n FROM movie_paths GROUP BY 1"))
def a3_rel_under(spark, sf_dir):
    return X.movie_paths(spark, sf_dir).groupBy(catalog.rel_under("Exp1", F.col("path")).alias("rel")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("movie_paths", then="SELECT split_part(path, '/', 2) AS protein, count(*) AS movies FROM movie_paths GROUP BY ROLLUP (1)"))
def a4_discovery_summary(spark, sf_dir):
    return catalog.discovery_summary(catalog.movie_catalog(X.movie_paths(spark, sf_dir)))


@query(with_sql("movie_paths", then="SELECT path, count(*) AS n FROM movie_paths WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(^|_)scGrx1[_-]') GROUP BY 1"))
def a5_compound_match(spark, sf_dir):
    return X.movie_paths(spark, sf_dir).where(catalog.compound_match(F.col("path"), "scGrx1")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("movie_paths", then="SELECT experiment, count(*) AS n FROM (SELECT CASE WHEN path LIKE 'Exp1/%' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS experiment FROM movie_paths) GROUP BY 1"))
def a6_experiment_from_path(spark, sf_dir):
    return X.movie_paths(spark, sf_dir).groupBy(catalog.experiment_from_path(F.col("path"), "Exp1").alias("experiment")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("movie_paths", then="""n AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM movie_paths),
 k AS (SELECT path, dir, split_part(name, '_', 1) AS prefix, regexp_extract(name, '_(\\d{4})\\.', 1) AS num, name FROM n)
 SELECT p.path AS protein_path, max(g.path) AS gt_path FROM k p JOIN k g USING (dir, prefix, num) WHERE p.name LIKE '%\\_640nm%' ESCAPE '\\' AND g.name LIKE '%\\_488nm%' ESCAPE '\\' GROUP BY 1"""))
def c1_channel_pairs(spark, sf_dir):
    return catalog.pair_channels(X.movie_paths(spark, sf_dir).distinct(), "640", "488")


@query(with_sql("movie_paths", then="""n AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM movie_paths), k AS (SELECT path, replace(replace(path, '_640nm', ''), '_488nm', '') AS key, name FROM n)
 SELECT path AS protein_path FROM k p WHERE name LIKE '%640nm%' AND NOT EXISTS (SELECT 1 FROM k g WHERE g.key = p.key AND g.name LIKE '%488nm%')"""))
def c1_unpaired(spark, sf_dir):
    return catalog.unpaired(X.movie_paths(spark, sf_dir).distinct(), "640", "488")


@query("SELECT max(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 AS next FROM customer")
def a23_next_run_number(spark, sf_dir):
    names = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("run_"), F.regexp_extract("c_name", "(\\d+)$", 1)).alias("run_name"))
    return catalog.next_run_number(names)


@query(with_sql("movie_paths", then="SELECT array_to_string(list_sort(list(DISTINCT split_part(path, '/', 2))), '_') || '_optparam' AS run_name FROM movie_paths"))
def a24_run_name(spark, sf_dir):
    return catalog.run_name(catalog.movie_catalog(X.movie_paths(spark, sf_dir)), "optparam")


_PARAMS = "pairs AS (SELECT DISTINCT split_part(path, '/', 1) AS experiment, split_part(path, '/', 2) AS protein FROM movie_paths), x AS (SELECT experiment, protein, CASE WHEN experiment = 'Exp1' AND protein LIKE 'Halo%' THEN 11000 WHEN protein = 'SNAPC148' THEN 9000 WHEN protein = 'HaloK117' THEN 7000 ELSE 5000 END::DOUBLE AS gradient, CASE WHEN (experiment = 'Exp1' AND protein LIKE 'Halo%') OR protein IN ('SNAPC148', 'HaloK117') THEN 'optimized' ELSE 'config_defaults' END AS source FROM pairs)"


def _parameters(spark, sf_dir):
    pairs = catalog.movie_catalog(X.movie_paths(spark, sf_dir)).select("experiment", "protein").distinct()
    by_experiment = pairs.where("experiment = 'Exp1' and protein like 'Halo%'").withColumn("gradient", F.lit(11000.0))
    by_protein = pairs.select("protein").distinct().where("protein in ('SNAPC148', 'HaloK117')").withColumn("gradient", F.when(F.col("protein") == "SNAPC148", 9000.0).otherwise(7000.0))
    return catalog.resolve_parameters(pairs, by_experiment, by_protein, 5000.0)


@query(with_sql("movie_paths", then=_PARAMS + " SELECT * FROM x"))
def a25_parameters(spark, sf_dir):
    return _parameters(spark, sf_dir)


@query(with_sql("movie_paths", then="SELECT CASE WHEN path LIKE '%640nm%' THEN 640.5 ELSE 488.5 END::DOUBLE AS gradient, count(*) AS n FROM movie_paths GROUP BY 1"))
def a25_channel_gradient(spark, sf_dir):
    return X.movie_paths(spark, sf_dir).groupBy(catalog.channel_of(F.col("path"), {"640": 640.5, "488": 488.5}).alias("gradient")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("movie_paths", then=_PARAMS + " SELECT *, 'run_1' AS run FROM x"))
def a26_parameters_used(spark, sf_dir):
    return sinks.parameters_used(_parameters(spark, sf_dir), "run_1")


@query(with_sql("movie_paths", then="SELECT protein, coalesce(CASE WHEN protein LIKE 'Halo%' THEN 'Exp9' END, 'Unknown') AS experiment, count(*) AS n FROM (SELECT split_part(path, '/', 2) AS protein FROM movie_paths) GROUP BY 1, 2"))
def c8_lookup_default(spark, sf_dir):
    rows = catalog.movie_catalog(X.movie_paths(spark, sf_dir)).select("protein")
    known = rows.where("protein like 'Halo%'").distinct().withColumn("experiment", F.lit("Exp9"))
    return rows.join(known, "protein", "left").groupBy("protein", F.coalesce("experiment", F.lit("Unknown")).alias("experiment")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("rois", then="SELECT movie_id AS movie, 'protein' AS kind, count(*) AS n, 'succeeded' AS status FROM rois GROUP BY 1"))
def a17_status_table(spark, sf_dir):
    return sinks.status_table(X.rois(spark, sf_dir).select(F.col("movie_id").alias("movie"), F.lit("protein").alias("kind"), "roi"))


@query(with_sql("traces", then="SELECT trace_id, class_idx, 'embeddings' AS origin FROM traces"))
def a19_provenance(spark, sf_dir):
    return sinks.provenance(X.traces(spark, sf_dir).withColumn("origin", F.lit("embeddings")))


@query(with_sql("two_class_values", then="n AS (SELECT class_name, value, row_number() OVER (PARTITION BY class_name ORDER BY event_id) - 1 AS r FROM two_class_values) SELECT CAST(r AS INT) AS \"row\", max(value) FILTER (WHERE class_name = 'click') AS click, max(value) FILTER (WHERE class_name = 'view') AS view FROM n GROUP BY 1"))
def a20_wide_columns(spark, sf_dir):
    return stats.wide_columns(X.two_class_values(spark, sf_dir), "class_name", ["click", "view"], "value", ["event_id"])


@query(with_sql("movie_paths", then="SELECT DISTINCT path FROM movie_paths ORDER BY 1"))
def g7_sorted_distinct_files(spark, sf_dir):
    return X.movie_paths(spark, sf_dir).distinct().orderBy("path")


@query(with_sql("movie_paths", then="SELECT path, 'x' AS part FROM movie_paths WHERE path LIKE 'Exp1/%' UNION ALL SELECT path, 'y' FROM movie_paths WHERE path LIKE 'Exp2/%' UNION ALL SELECT path, 'z' FROM movie_paths WHERE path LIKE 'Exp3/%'"))
def g1_union_all(spark, sf_dir):
    rows = X.movie_paths(spark, sf_dir)
    parts = [rows.where(F.col("path").startswith(f"Exp{i}/")).withColumn("part", F.lit(p)) for i, p in ((1, "x"), (2, "y"), (3, "z"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_sql("frames", "traces", then="SELECT trace_id FROM frames INTERSECT SELECT trace_id FROM traces"))
def g6_intersect(spark, sf_dir):
    return X.frames(spark, sf_dir).select("trace_id").intersect(X.traces(spark, sf_dir).select("trace_id"))


@query("SELECT regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g') AS slug, CASE WHEN p_size % 3 = 0 THEN 'no aug' ELSE concat('aug x', p_size % 3) END AS aug, count(*) AS n FROM part GROUP BY 1, 2")
def h22_labels(spark, sf_dir):
    rows = X.table(spark, sf_dir, "part")
    f = F.col("p_size") % 3
    return rows.groupBy(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "-").alias("slug"), F.when(f == 0, "no aug").otherwise(F.concat(F.lit("aug x"), f.cast("string"))).alias("aug")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("rois", then="SELECT concat('movie=', movie_id) AS folder, 'HaloD106' AS label, count(*) AS traces FROM rois GROUP BY 1"))
def a10_tagged_scan(spark, sf_dir):
    """Written one folder a movie, scanned with the file each row came from."""
    path = scratch.folder(spark, "scan")
    X.rois(spark, sf_dir).withColumn("movie", F.col("movie_id")).write.partitionBy("movie").parquet(path)
    rows = catalog.tagged_scan(spark, path, "HaloD106")
    return rows.groupBy(F.regexp_extract("origin", "/(movie=[^/]*)/", 1).alias("folder"), "label").agg(F.count(F.lit(1)).alias("traces"))


@query(with_sql("tframes", then="SELECT trace_id, count(*) AS frames, round(sum(intensity), 6) AS total FROM tframes WHERE class_idx = 3 AND trace_id % 7 <> 0 GROUP BY 1"))
def a11_trace_matrix(spark, sf_dir):
    """One compound and normalisation; mirrored series (here every seventh trace) are left out."""
    rows = _stored(spark, sf_dir).where("norm = 'raw'")
    found = catalog.class_slice(rows, "class_3", "raw")
    return rounded(found.select("trace_id", F.size("values").cast("long").alias("frames"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total")))


@query(with_sql("tframes", then="SELECT class_idx, norm, count(DISTINCT trace_id) AS traces FROM tframes, (SELECT unnest(['raw', 'minmax']) AS norm) WHERE class_idx IN (1, 4) AND trace_id % 7 <> 0 GROUP BY 1, 2"))
def a12_class_tables(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    chosen = [catalog.class_slice(rows, f"class_{c}", n) for c in (1, 4) for n in ("raw", "minmax")]
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out.groupBy("class_idx", "norm").agg(F.count(F.lit(1)).alias("traces"))


def _stored(spark, sf_dir):
    """Traces by compound and normalisation, written and read back."""
    path = scratch.folder(spark, "traces")
    rows = X.traces(spark, sf_dir).withColumn("compound", F.concat(F.lit("class_"), F.col("class_idx").cast("string")))
    rows = rows.withColumn("trace_name", F.concat("trace_id", F.when(F.col("trace_id") % 7 == 0, "_m").otherwise("")))
    rows = rows.withColumn("gt_label", F.when(F.col("trace_id") % 2 == 0, "IN").otherwise("OUT")).withColumn("origin", F.lit("protein"))
    sinks.write_traces(rows.withColumn("norm", F.explode(F.array(F.lit("raw"), F.lit("minmax")))), path)
    return spark.read.parquet(path)


@query(with_sql("traces", then="SELECT concat('class_', class_idx) AS compound, CASE WHEN trace_id % 2 = 0 THEN 'IN' ELSE 'OUT' END AS gt_label, 'protein' AS origin, norm, count(*) AS traces FROM traces, (SELECT unnest(['raw', 'minmax']) AS norm) GROUP BY 1, 2, 3, 4"))
def a18_partitioned_sink(spark, sf_dir):
    return _stored(spark, sf_dir).groupBy("compound", "gt_label", "origin", "norm").agg(F.count(F.lit(1)).alias("traces"))


@query(with_sql("traces", then="SELECT concat('class_', class_idx) AS compound, CASE WHEN trace_id % 2 = 0 THEN 'IN' ELSE 'OUT' END AS gt_label, 'protein' AS origin, norm, CAST(trace_id % 12 AS VARCHAR) AS movie, count(*) AS traces, CAST(sum(trace_id) AS BIGINT) AS ids FROM traces, (SELECT unnest(['raw', 'minmax']) AS norm) GROUP BY 1, 2, 3, 4, 5"))
def a18_resumable_sink(spark, sf_dir):
    """A first attempt breaks after some movies' traces were written, twice over and some under another label; then the sink is run twice."""
    path = scratch.folder(spark, "resumable")
    rows = X.traces(spark, sf_dir).withColumns({"compound": F.concat(F.lit("class_"), F.col("class_idx").cast("string")), "gt_label": F.when(F.col("trace_id") % 2 == 0, "IN").otherwise("OUT"), "origin": F.lit("protein"), "movie": (F.col("trace_id") % 12).cast("string")})
    rows = rows.withColumn("norm", F.explode(F.array(F.lit("raw"), F.lit("minmax"))))
    half = rows.where("trace_id % 12 < 5")
    broken = half.unionByName(half).unionByName(half.withColumn("gt_label", F.lit("LOST"))).withColumn("attempt", F.lit("broken"))
    broken.write.partitionBy(*sinks.PARTITIONS, "movie").parquet(f"{path}/traces")
    movies = rows.select("movie").where("movie % 3 <> 1")
    sinks.write_resumable(rows, movies, path)
    for _ in range(2):
        sinks.write_resumable(rows, rows, path)
    found = sinks.read_resumable(spark, path)
    return found.groupBy("compound", "gt_label", "origin", "norm", "movie").agg(F.count(F.lit(1)).alias("traces"), F.sum("trace_id").alias("ids"))


@query(with_sql("predictions_mc", then=_WD + " SELECT class_name, count(*) AS n, round(avg(wd), 6) AS mean_wd FROM (SELECT concat('class_', label) AS class_name, round(wd, 9) AS wd FROM wd) WHERE wd >= 0.2 GROUP BY 1"))
def a15_certainty_scan(spark, sf_dir):
    """The certainty table is written once and scanned with the least distance pushed down."""
    path = scratch.folder(spark, "certainty")
    rows = certainty.certainty(long_passes(spark, sf_dir)).select("sample_id", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class_name"), F.round("wd", 9).alias("wd"))
    rows.write.parquet(path)
    return rounded(catalog.certainty_scan(spark, path, 0.2).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.avg("wd").alias("mean_wd")))


@query(with_sql("traces", then="SELECT trace_id, class_idx FROM traces"))
def a16_choose_dataset(spark, sf_dir):
    tables = {"short": X.traces(spark, sf_dir), "long": X.long_traces(spark, sf_dir)}
    return catalog.choose_dataset(tables, "short").select("trace_id", "class_idx")


@query(with_sql("fold_metrics", then="SELECT format, model, aug_factor, fold, round(auc, 6) AS auc FROM fold_metrics, (SELECT unnest(['csv', 'json']) AS format)"))
def a21_result_sinks(spark, sf_dir):
    """Long results as CSV and as JSON, read back."""
    rows = X.fold_metrics(spark, sf_dir).select("model", "aug_factor", "fold", "auc")
    csv, json = scratch.folder(spark, "csv"), scratch.folder(spark, "json")
    sinks.write_csv(rows, csv)
    sinks.write_json(rows, json)
    back = spark.read.schema(rows.schema).csv(csv, header=True).withColumn("format", F.lit("csv"))
    return rounded(back.unionByName(spark.read.schema(rows.schema).json(json).withColumn("format", F.lit("json"))))


@query(with_sql("movie_paths", then="p AS (SELECT split_part(path, '/', 2) AS file, min(path) AS line FROM movie_paths GROUP BY 1) SELECT file, CASE WHEN file LIKE 'Halo%' THEN md5(concat(line, chr(10))) ELSE md5(line) END AS md5, md5(concat(line, chr(10))) AS actual, file LIKE 'Halo%' AS ok FROM p"))
def a22_checksums(spark, sf_dir):
    """A file a protein, with a manifest that is right for some of them."""
    path = scratch.folder(spark, "files")
    rows = X.movie_paths(spark, sf_dir).groupBy(F.split("path", "/")[1].alias("file")).agg(F.min("path").alias("line"))
    rows.write.partitionBy("file").text(path)
    right = F.md5(F.concat("line", F.lit("\n")))
    manifest = rows.select("file", F.when(F.col("file").startswith("Halo"), right).otherwise(F.md5("line")).alias("md5"))
    return sinks.checksums(spark, path, manifest, "file=([^/]*)/")


@query(with_sql("rois", "gt_spots", then=_PAINT + f", d AS (SELECT r.movie_id, r.roi, coalesce(min((r.x-g.x)*(r.x-g.x) + (r.y-g.y)*(r.y-g.y)) < {DISTANCE * DISTANCE}, false) AS inside FROM rois r LEFT JOIN gt_spots g USING (movie_id) GROUP BY 1, 2) SELECT d.movie_id, d.roi, CASE WHEN inside THEN 'IN' ELSE 'OUT' END AS subset FROM d LEFT JOIN o ON d.movie_id = o.movie_id AND d.roi = o.roi WHERE o.roi IS NULL"))
def b3_split_by_ground_truth(spark, sf_dir):
    return catalog.split_by_ground_truth(labelled_rois(spark, sf_dir)).select("movie_id", "roi", "subset")


@query(with_sql("movie_paths", then="SELECT path, split_part(path, '/', 1) AS experiment, split_part(path, '/', 2) AS protein FROM movie_paths WHERE path LIKE 'Exp2/HaloD106/%'"))
def b13_debug_filters(spark, sf_dir):
    return catalog.only(catalog.movie_catalog(X.movie_paths(spark, sf_dir)), "Exp2", "HaloD106").select("path", "experiment", "protein")
