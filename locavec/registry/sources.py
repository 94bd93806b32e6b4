"""Queries for readers, writers, the catalogue and suite assembly.

Each writes a table derived from the given ones to the shared folder and reads it back.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean
from ..plans import summary_job
from ..session import shared_dir
from ..sources import catalog, files
from .core import ANN, CELLROWS, PTS, R, RESULTS, VECS, W, lat_sql, lon_sql, query, r

_CANON = W(PTS) + (f"SELECT id::VARCHAR AS id, {r('lon')} AS lon, {r('lat')} AS lat, epoch_ms(make_date(year,1,1)::TIMESTAMP) AS timestamp, "
                   "'all' AS split, y, cls FROM pts")


def _canonical(spark, sf):
    return clean.canonicalize(X.points(spark, sf), lon="lon", lat="lat", timestamp="year", unit="year", split_value="all", id="id")


def _show(d):
    return d.select("id", R("lon").alias("lon"), R("lat").alias("lat"), "timestamp", "split", "y", "cls")


@query("src1_read_canonical", _CANON)
def src1(spark, sf):
    root = shared_dir(spark, "canonical")
    _canonical(spark, sf).write.parquet(f"{root}/data/points/data.parquet")
    return _show(files.read_canonical(spark, root, "points"))


@query("src2_read_csv", W(PTS) + """SELECT id, cls AS segment, year, CASE WHEN id%17=0 THEN -999.0 WHEN id%19=0 THEN NULL ELSE y END::DOUBLE AS population,
 (CASE WHEN id%5<>0 THEN """ + r("lat") + " END)::DOUBLE AS latitude FROM pts")
def src2(spark, sf):
    path = shared_dir(spark, "csv")
    X.raw_source(spark, sf).write.option("header", True).csv(path)
    schema = " id long, Latitude double, Longitude double, Geolocation string, Population double, Year int, segment string".strip()
    d = files.read_csv(spark, path, schema, lower=True)
    return d.select("id", "segment", "year", "population", R("latitude").alias("latitude"))


@query("src3_read_cities", f"SELECT {r(lat_sql('s_suppkey'))} AS lat, {r(lon_sql('s_suppkey'))} AS lon, 10000+floor(abs(s_acctbal)*10) AS population "
       "FROM supplier WHERE 10000+floor(abs(s_acctbal)*10)>=15000")
def src3(spark, sf):
    path = shared_dir(spark, "cities")
    i = F.col("s_suppkey")
    c = {0: i.cast("string"), 1: F.col("s_name"), 4: X.lat_of(i).cast("string"), 5: X.lon_of(i).cast("string"),
         14: (10000 + F.floor(F.abs("s_acctbal") * 10)).cast("string")}
    X.table(spark, sf, "supplier").select(*[c.get(k, F.lit("x")).alias(f"c{k}") for k in range(19)]).write.option("sep", "\t").csv(path)
    return files.read_cities(spark, path).select(R("lat").alias("lat"), R("lon").alias("lon"), "population")


@query("src4_discover", "SELECT event_type AS stem, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type<>'error' GROUP BY 1")
def src4(spark, sf):
    """One folder of CSV files per event type, renamed so that each file carries the type's name."""
    root = shared_dir(spark, "evaluation")
    e = X.table(spark, sf, "events").select("event_type", F.col("event_id").alias("label"), F.col("value").alias("x"))
    e.write.partitionBy("event_type").option("header", True).csv(root)
    fs, p = files._fs(spark, root)
    for i, f in enumerate(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/event_type=*/part-*"))):
        src = f.getPath()
        kind = src.getParent().getName().split("=")[1]
        name = f"trial_groups_{i}" if kind == "error" else f"{kind}-{i}"
        fs.rename(src, spark._jvm.org.apache.hadoop.fs.Path(src.getParent(), f"{name}.csv"))
    found = files.discover(spark, root)
    d = spark.read.option("header", True).schema("label long, x double").csv([row["path"] for row in found.collect()])
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"-[0-9]+\.csv$", "")
    return d.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ids"))


@query("src5_classify_tables", "SELECT 'teacher' AS role, count(*)::BIGINT AS n FROM embeddings UNION ALL SELECT 'annual', 3*count(*)::BIGINT FROM embeddings")
def src5(spark, sf):
    root = shared_dir(spark, "tables")
    t = X.teachers(spark, sf)
    files.write_points(t, f"{root}/a", ["ta", "tb", "tc"])
    X.annual(spark, sf).write.parquet(f"{root}/b")
    teach, ann = files.classify_tables(spark, [f"{root}/b", f"{root}/a"], ["ta", "tb", "tc"])
    count = lambda role, paths: spark.read.parquet(*paths).agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "n")
    return count("teacher", teach).unionByName(count("annual", ann))


def _targets(spark, sf):
    a = X.annual(spark, sf).groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("year", "aef"))).alias("t"))  # three years each
    t = X.teachers(spark, sf).select("point_id", "lat", "lon")
    return t.join(a, "point_id").select("point_id", "lat", "lon", F.transform("t", lambda x: x["aef"]).alias("targets"))


YEARS = (2017, 2018, 2019)


@query("src6_read_shards", W(VECS, ANN) + f"SELECT {r('v.lat', 2)} AS lat, {r('v.lon', 2)} AS lon, sum(list_sum(aef))::BIGINT AS total, count(*)::BIGINT AS years "
       "FROM ann JOIN vecs v ON v.id=point_id GROUP BY v.id, v.lat, v.lon")
def src6(spark, sf):
    root = shared_dir(spark, "shards")
    files.write_shards(_targets(spark, sf), root, YEARS)
    d, _ = files.read_shards(spark, root)
    tot = F.aggregate(F.flatten("targets"), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(R("lat", 2).alias("lat"), R("lon", 2).alias("lon"), tot.alias("total"), F.size("targets").cast("long").alias("years"))


@query("src7_write_shards", "SELECT count(*)::BIGINT AS n_samples, 3::BIGINT AS n_years, 'signed_square' AS dequant, true AS within_limit FROM embeddings")
def src7(spark, sf):
    root = shared_dir(spark, "shards")
    m = files.write_shards(_targets(spark, sf), root, YEARS, shard_rows=100)
    d, back = files.read_shards(spark, root)
    ids = files.number_shards(d, back)
    return ids.agg(F.count_distinct("point_id").alias("n_samples"), F.lit(len(back["years"])).cast("long").alias("n_years"),
                   F.lit(back["dequant"]).alias("dequant"), F.lit(max(m["counts"]) <= 100).alias("within_limit"))


@query("src8_write_points", W(VECS) + f"SELECT id AS point_id, {r('lon')} AS xmin, {r('lat')} AS ymin, 21::INT AS bytes, {r('list_sum(v[1:32])', 5)} AS ta FROM vecs")
def src8(spark, sf):
    path = shared_dir(spark, "points")
    files.write_points(X.teachers(spark, sf), path, ["ta", "tb", "tc"])
    d = spark.read.parquet(path)
    return d.select("point_id", R("bbox.xmin").alias("xmin"), R("bbox.ymin").alias("ymin"), F.octet_length("geometry").alias("bytes"),
                    R(F.aggregate("ta", F.lit(0.0), lambda s, x: s + x), 5).alias("ta"))


@query("src9_write_annual", W(ANN) + "SELECT point_id, year, list_sum(aef)::BIGINT AS total FROM ann")
def src9(spark, sf):
    path = shared_dir(spark, "annual")
    files.write_annual(_targets(spark, sf), path, YEARS)
    return spark.read.parquet(path).select("point_id", F.col("year").cast("int").alias("year"), F.aggregate(
        "aef", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("src10_write_canonical", _CANON)
def src10(spark, sf):
    return _show(spark.read.parquet(files.write_canonical(_canonical(spark, sf), shared_dir(spark, "out"), "points")))


@query("src11_append_results", W(RESULTS) + f"SELECT benchmark, count(*)::BIGINT AS n, {r('sum(score)', 4)} AS total FROM results GROUP BY 1")
def src11(spark, sf):
    path = shared_dir(spark, "results")
    d = X.results(spark, sf)
    for seed in range(5):
        files.append_results(d.where(F.col("seed") == seed).withColumn("dataset", F.col("benchmark")), path)
    return spark.read.parquet(path).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), R(F.sum("score"), 4).alias("total"))


def _manifest(spark, sf):
    root = shared_dir(spark, "manifest")
    d = X.results(spark, sf)
    specs = []
    for seed in range(5):
        d.where(F.col("seed") == seed).drop("seed").write.option("header", True).csv(f"{root}/run{seed}")
        specs.append({"path": f"run{seed}/part-*.csv", "seed": seed})
    files.write_text(spark, f"{root}/manifest.json", json.dumps(specs))
    return f"{root}/manifest.json"


@query("src12_load_results", W(RESULTS) + f"SELECT seed::INT AS seed, encoder, count(*)::BIGINT AS n, {r('sum(score)', 4)} AS total FROM results GROUP BY 1,2")
def src12(spark, sf):
    d = files.load_results(spark, _manifest(spark, sf), range(5))
    return d.groupBy("seed", "encoder").agg(F.count(F.lit(1)).alias("n"), R(F.sum("score"), 4).alias("total"))


_CAT = ",".join(f"({i},'{e[0]}','{e[1]}','{e[4]}','{e[5]}',{str(e[6]).lower()})" for i, e in enumerate(catalog.ENTRIES))


@query("src13_catalog_join", f"WITH c(i,key,family,license_status,task_type,snapshot) AS (VALUES {_CAT}) SELECT family, license_status, task_type, count(*)::BIGINT AS n, "
       f"count(*) FILTER (snapshot)::BIGINT AS sampled FROM part JOIN c ON i=p_partkey%{len(catalog.ENTRIES)} GROUP BY 1,2,3")
def src13(spark, sf):
    keys = F.array(*[F.lit(e[0]) for e in catalog.ENTRIES])
    p = X.table(spark, sf, "part").select(F.get(keys, (F.col("p_partkey") % len(catalog.ENTRIES)).cast("int")).alias("table"))
    return catalog.with_catalog(p, "table").groupBy("family", "license_status", "task_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("snapshot").alias("sampled"))


@query("src13_file_license", "SELECT CASE p_partkey%4 WHEN 0 THEN 'CC-BY-NC-4.0 (iNaturalist)' WHEN 1 THEN 'Open Government Licence - Canada' ELSE 'CC-BY-4.0' END AS license, "
       "count(*)::BIGINT AS n FROM part GROUP BY 1")
def src13b(spark, sf):
    stems = F.array(*[F.lit(s) for s in ("us_trees", "canada_crops_fine", "glance", "descals")])
    p = X.table(spark, sf, "part").select(F.get(stems, (F.col("p_partkey") % 4).cast("int")).alias("stem"))
    return p.groupBy(catalog.license_of("stem").alias("license")).agg(F.count(F.lit(1)).alias("n"))


@query("src14_suite", W(PTS, VECS) + f"SELECT 'points' AS dataset, 'y' AS task, count(*)::BIGINT AS n, {r('sum(y)', 2)} AS total FROM pts UNION ALL "
       f"SELECT 'points','lat',count(*)::BIGINT,{r('sum(lat)', 2)} FROM pts UNION ALL SELECT 'vectors','y',count(*)::BIGINT,{r('sum(y)', 2)} FROM vecs")
def src14(spark, sf):
    s = catalog.Suite()
    long = lambda d, name, tasks: clean.melt_tasks(d, ["id"], tasks).withColumn("dataset", F.lit(name))
    s.register("points", lambda: long(X.points(spark, sf), "points", ["y", "lat"]))
    s.register("vectors", lambda: long(X.vectors(spark, sf), "vectors", ["y"]).withColumn("width", F.lit(64)))
    s.register("unused", lambda: X.points(spark, sf))
    return s.gather(["points", "vectors"]).groupBy("dataset", "task").agg(F.count(F.lit(1)).alias("n"), R(F.sum("y"), 2).alias("total"))


def _store(spark, sf):
    path = shared_dir(spark, "cells")
    c = X.cell_rows(spark, sf).select(
        F.lit(5).alias("level"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("band"), "row", "col", "lat", "lon", F.col("valid").alias("mask"), "n")
    files.write_cell_store(c.withColumn("q", F.array((F.col("n") + F.col("band")).cast("smallint"))), path)
    return path


@query("src15_cell_scan", W(CELLROWS) + f"SELECT row, col, {r('lat')} AS lat, n+1 AS q FROM cells WHERE valid AND lat>=-40")
def src15(spark, sf):
    d = files.read_cells(spark, _store(spark, sf), 5, 1, lat_min=-40.0)
    return d.select("row", "col", R("lat").alias("lat"), F.col("q")[0].cast("long").alias("q"))


@query("src16_overview_scan", W(CELLROWS) + "SELECT row*360+col AS cell, n AS count, n*2.0 AS pca1, n*3.0 AS pca2, n*5.0 AS pca3 FROM cells")
def src16(spark, sf):
    path = shared_dir(spark, "overview")
    X.cell_rows(spark, sf).select((F.col("row") * 360 + F.col("col")).alias("cell"), F.col("n").alias("count"), *[
        (F.col("n") * float(k)).alias(f"pca{i}") for i, k in ((1, 2), (2, 3), (3, 5))], "lat", "lon").write.parquet(path)
    return files.read_overview(spark, path)


_SUM = W(RESULTS).rstrip() + """, o AS (SELECT benchmark, cell_deg, max(median_nn_train_km) AS d FROM results GROUP BY 1,2),
 lg AS (SELECT *, lag(cell_deg) OVER w AS p, lag(d) OVER w AS pd FROM o WINDOW w AS (PARTITION BY benchmark ORDER BY cell_deg)),
 bad AS (SELECT benchmark, cell_deg FROM lg WHERE p>0 AND d=pd),
 t AS (SELECT seed, encoder AS method, cell_deg AS value, benchmark, family, avg(greatest(score,-1.0)) AS s FROM results ANTI JOIN bad USING (benchmark, cell_deg) GROUP BY 1,2,3,4,5),
 c AS (SELECT value, benchmark FROM t GROUP BY 1,2 HAVING count(DISTINCT (seed,method))=15), k AS (SELECT t.* FROM t JOIN c USING (value, benchmark)),
 ps AS (SELECT method, value, seed, 'all' AS family, avg(s) AS s, count(*) AS n, string_agg(benchmark, ';' ORDER BY benchmark) AS names FROM k GROUP BY 1,2,3
  UNION ALL SELECT method, value, seed, family, avg(s), count(*), string_agg(benchmark, ';' ORDER BY benchmark) FROM k GROUP BY 1,2,3,4)
 SELECT method, 'regression' AS task_type, family, value, """ + f"{r('avg(s)')} AS mean, {r('stddev_samp(s)')} AS std, max(n)::BIGINT AS n_benchmarks, max(names) AS benchmarks FROM ps GROUP BY 1,3,4"


@query("mdl18_summary_job", _SUM)
def mdl18(spark, sf):
    s = summary_job.summarize_manifest(spark, _manifest(spark, sf), categories=True)
    return s.select("method", "task_type", "family", "value", R("mean").alias("mean"), R("std").alias("std"),
                    F.col("n_benchmarks").cast("long").alias("n_benchmarks"), "benchmarks")
