"""Queries for joins, set operations, windows, result summaries and cell aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import color, geo
from ..functions import vectors as V
from ..operators import clean, joins, metrics, stats, summary
from ..operators import neighbours as NB
from ..operators.summary import floor_score
from ..session import shared_dir
from ..sources import files
from .core import ANN, CELLROWS, PTS, R, RESULTS, SHARDS, UNIT, VECS, W, XYZ, query, r

# --------------------------------------------------------------------------- identifier joins

_MEAN = "m AS (SELECT id, j, avg(x) AS x FROM (SELECT id, unnest(u) AS x, generate_subscripts(u,1) AS j FROM unit) GROUP BY 1,2)"


@query("jon1_teacher_annual", W(ANN, UNIT, VECS, _MEAN) + f"SELECT m.id AS point_id, {r('sum(m.x)')} AS total, {r('sum(m.x*m.x)')} AS sq, {r('any_value(v[1])')} AS ta0 "
       "FROM m JOIN vecs USING (id) GROUP BY 1")
def jon1(spark, sf):
    d = joins.join_annual(X.teachers(spark, sf), X.annual(spark, sf), ["ta", "tb", "tc"])
    return d.select("point_id", R(F.aggregate("aef_mean", F.lit(0.0), lambda s, x: s + x)).alias("total"), R(V.squared_norm("aef_mean")).alias("sq"),
                    R(F.col("ta")[0]).alias("ta0"))


def _broken(spark, sf):
    a = X.annual(spark, sf)
    i, y = F.col("point_id"), F.col("year")
    lost = a.where(~((i % 50 == 0) & (y == 2018)))
    twice = lost.unionByName(a.where((i % 60 == 1) & (y == 2017)))
    orphan = twice.unionByName(a.where(i % 70 == 2).withColumn("point_id", i + 10_000_000))
    return orphan.withColumn("aef", F.when((i % 80 == 3) & (y == 2019), F.concat(F.slice("aef", 1, 63), F.array(F.lit(-128).cast("tinyint"))))
                             .when((i % 90 == 4) & (y == 2019), None).otherwise(F.col("aef")))


@query("agg19_integrity", """WITH e AS (SELECT vec_id AS i FROM embeddings) SELECT 0::BIGINT AS duplicate_points, (SELECT count(*)::BIGINT FROM e WHERE i%70=2) AS orphans,
 (SELECT count(*)::BIGINT FROM e WHERE i%60=1) AS duplicate_years,
 (SELECT count(*)::BIGINT FROM e WHERE i%50=0) AS missing_years,
 (SELECT count(*)::BIGINT FROM e WHERE i%90=4 AND i%80<>3)+(SELECT count(*)::BIGINT FROM e WHERE i%70=2 AND (i+10000000)%90=4 AND (i+10000000)%80<>3) AS null_vectors,
 (SELECT count(*)::BIGINT FROM e WHERE i%80=3)+(SELECT count(*)::BIGINT FROM e WHERE i%70=2 AND (i+10000000)%80=3) AS nodata_vectors, 0::BIGINT AS bad_teachers""")
def agg19(spark, sf):
    """A healthy teacher table against annual vectors with one fault of every kind, counted by kind."""
    return joins.annual_violations(X.teachers(spark, sf), _broken(spark, sf), ["ta", "tb", "tc"])


@query("jon2_fill_coordinates", W(PTS) + f"SELECT id, y, {r('lat')} AS lat, {r('lon')} AS lon, (SELECT count(*)::BIGINT FROM pts WHERE id%6=0 AND id%4=0) AS dropped FROM pts WHERE NOT (id%6=0 AND id%4=0)")
def jon2(spark, sf):
    p = X.points(spark, sf)
    a = p.select("id", F.when(F.col("id") % 6 != 0, F.col("lat")).alias("lat"), "lon")
    b = p.select("id", F.when(F.col("id") % 4 != 0, F.col("lat")).alias("lat"), "lon")
    got, lost = clean.fill_coordinates(p.select("id", "y"), [a, b])
    return got.select("id", "y", R("lat").alias("lat"), R("lon").alias("lon"), F.lit(lost.count()).cast("long").alias("dropped"))


@query("jon3_pool", W(PTS) + "SELECT id, y FROM pts WHERE cls='MACHINERY'")
def jon3(spark, sf):
    p = X.points(spark, sf)
    return clean.keep_pool(p, p.where(F.col("cls") == "MACHINERY")).select("id", "y")


_PIP = W(PTS).rstrip() + f""", e(poly,label,x1,y1,x2,y2) AS (VALUES {X.polygon_edge_values()}), h AS (SELECT id, poly, label,
 sum(CASE WHEN (y1>lat)<>(y2>lat) AND lon<(x2-x1)*(lat-y1)/(CASE WHEN y2=y1 THEN 1 ELSE y2-y1 END)+x1 THEN 1 ELSE 0 END) AS c,
 bool_or((x2-x1)*(lat-y1)-(y2-y1)*(lon-x1)=0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2) AND lat BETWEEN least(y1,y2) AND greatest(y1,y2)) AS edge
 FROM pts, e GROUP BY 1,2,3), inn AS (SELECT * FROM h WHERE c%2=1 AND NOT edge) """


@query("jon4_point_in_polygon", _PIP + "SELECT id, poly, label FROM inn")
def jon4(spark, sf):
    return joins.point_in_polygon(X.points(spark, sf), X.polygons(spark)).select("id", "poly", "label")


_RC = ("rc AS (SELECT id, greatest(0,least(179,floor((lat-90)/-1.0::DOUBLE)))::BIGINT AS row, greatest(0,least(359,floor(lon+180)))::BIGINT AS col FROM pts)")


@query("jon5_raster_sample", W(PTS, _RC) + "SELECT id, (CASE WHEN ((row*31+col*17)%251)%13=0 THEN NULL ELSE (row*31+col*17)%251 END)::DOUBLE AS value FROM rc")
def jon5(spark, sf):
    return raster(spark, X.points(spark, sf)).select("id", "value")


def raster(spark, pts, out="value"):
    return joins.sample_raster(pts, X.raster_tiles(spark), x0=-180.0, y0=90.0, dx=1.0, dy=-1.0, height=180, width=360, tile=20, nodata=-1, out=out)


@query("jon6_on_land", _PIP + f"SELECT DISTINCT pts.id, {r('lat')} AS lat, {r('lon')} AS lon FROM pts JOIN inn ON inn.id=pts.id")
def jon6(spark, sf):
    return joins.on_land(X.points(spark, sf), X.polygons(spark)).select("id", R("lat").alias("lat"), R("lon").alias("lon"))


# --------------------------------------------------------------------------- neighbours

def folded(spark, sf):
    return X.points(spark, sf).withColumn("fold", (F.col("id") % 5).cast("int"))


_CHORD = "sqrt((a.x-b.x)*(a.x-b.x)+(a.yy-b.yy)*(a.yy-b.yy)+(a.z-b.z)*(a.z-b.z))"
_KM = f"2*6371.0*asin(least(1.0,{_CHORD}/2))"


@query("jon7_sphere_knn", W(PTS, XYZ) + f"SELECT qid, tid, km, rank FROM (SELECT a.id AS qid, b.id AS tid, {r(_KM, 4)} AS km, "
       f"(row_number() OVER (PARTITION BY a.id ORDER BY {_CHORD}, b.id))::INT AS rank FROM xyz a JOIN xyz b ON a.fold<>b.fold) WHERE rank<=5")
def jon7(spark, sf):
    return NB.sphere_knn(folded(spark, sf), k=5).select("qid", "tid", R("km", 4).alias("km"), "rank")


@query("jon8_nearest_train", W(PTS, XYZ) + f"SELECT a.id, a.fold, {r(f'min({_KM})', 4)} AS km FROM xyz a JOIN xyz b ON a.fold<>b.fold GROUP BY 1,2")
def jon8(spark, sf):
    return NB.nearest_train_km(folded(spark, sf)).select("id", "fold", R("km", 4).alias("km"))


@query("jon9_buffer_exclusion", W(PTS, XYZ, f"d AS (SELECT a.id, b.fold, min({_KM}) AS km FROM xyz a JOIN xyz b ON a.fold<>b.fold GROUP BY 1,2)") +
       "SELECT fold, rad AS radius_km, count(*) FILTER (NOT km<rad)::BIGINT AS kept, count(*)::BIGINT AS total FROM d, (VALUES (0.0::DOUBLE),(50.0),(100.0),(200.0)) t(rad) GROUP BY 1,2")
def jon9(spark, sf):
    d = NB.held_out_km(folded(spark, sf), 5, 200.0)
    return NB.buffer_flags(d, (0.0, 50.0, 100.0, 200.0)).groupBy("fold", "radius_km").agg(
        F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("total"))


_V2 = "vv AS (SELECT id, v, (id%5)::INT AS fold FROM vecs)"


@query("jon10_feature_knn", W(VECS, _V2) + "SELECT qid, tid, d, rank FROM (SELECT a.id AS qid, b.id AS tid, " + r("list_distance(a.v,b.v)") + " AS d, "
       "(row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v,b.v), b.id))::INT AS rank FROM vv a JOIN vv b ON a.fold<>b.fold) WHERE rank<=10")
def jon10(spark, sf):
    """Exact L2 neighbours across folds; leaves cut on the leading principal directions."""
    import numpy as np

    d = X.vectors(spark, sf).withColumn("grp", (F.col("id") % 5).cast("long"))
    gram = stats.gram_to_driver(d, "v")
    q = np.linalg.eigh(gram.covariance())[1][:, ::-1][:, :8].T
    p = stats.apply_linear(d, "v", "proj", q, np.zeros(8))
    rest = F.sqrt(F.greatest(F.lit(0.0), V.squared_norm("v") - V.squared_norm("proj")))
    p = p.select("id", "grp", F.col("v").alias("vec"), F.concat("proj", F.array(rest)).alias("ix"))
    hits = NB.nearest(p.withColumnRenamed("id", "qid"), p.withColumnRenamed("id", "tid"), k=10, mode="other", residual=True)
    return hits.select("qid", "tid", R("dist").alias("d"), "rank")


@query("jon11_containment", W(PTS) + "SELECT count(DISTINCT (lat,lon))::BIGINT AS coordinates, count(DISTINCT (lat,lon)) FILTER (id%50=0)::BIGINT AS missing, "
       "count(*) FILTER (id%50<>0 AND id%70=1)::BIGINT AS bad FROM pts")
def jon11(spark, sf):
    p = X.points(spark, sf).select("id", "lon", "lat", "y")
    norm = p.where(F.col("id") % 50 != 0).withColumn("y", F.when(F.col("id") % 70 == 1, F.col("y") + 1000).otherwise(F.col("y") * (1 + 1e-7)))
    return joins.containment(p, norm.unionByName(norm.where(F.col("id") % 3 == 0)), "y")


@query("jon11_text_containment", W(PTS) + "SELECT count(DISTINCT (lat,lon))::BIGINT AS coordinates, 0::BIGINT AS missing, "
       "count(*) FILTER (id%70=1)::BIGINT AS bad FROM pts")
def jon11b(spark, sf):
    p = X.points(spark, sf).select("id", "lon", "lat", "cls")
    return joins.containment(p, p.withColumn("cls", F.when(F.col("id") % 70 == 1, "other").otherwise(F.col("cls"))), "cls", numeric=False)


# --------------------------------------------------------------------------- windows, sorts, sets

@query("win1_saturated", W(RESULTS).rstrip() + """, o AS (SELECT benchmark, cell_deg, max(median_nn_train_km) AS d FROM results GROUP BY 1,2),
 l AS (SELECT *, lag(cell_deg) OVER w AS p, lag(d) OVER w AS pd FROM o WINDOW w AS (PARTITION BY benchmark ORDER BY cell_deg))
 SELECT benchmark, cell_deg FROM l WHERE p>0 AND d=pd""")
def win1(spark, sf):
    return summary.saturated(X.results(spark, sf))


@query("win2_top_k", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders) WHERE rank<=3")
def win2(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return X.table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("win3_arg_max", W(RESULTS) + "SELECT benchmark, task, seed::INT AS seed, arg FROM (SELECT benchmark, task, seed, encoder AS arg, row_number() OVER "
       "(PARTITION BY benchmark, task, seed ORDER BY score DESC, encoder, cell_deg) AS k FROM results) WHERE k=1")
def win3(spark, sf):
    g = X.results(spark, sf).groupBy("benchmark", "task", "seed").agg(F.min_by("encoder", F.struct((-F.col("score")).alias("s"), "encoder", "cell_deg")).alias("arg"))
    return g.select("benchmark", "task", F.col("seed").cast("int").alias("seed"), "arg")


@query("win4_rank_uniform", W(PTS) + f"SELECT id, {r('((row_number() OVER (ORDER BY y, id)-1)+0.5)/(count(*) OVER ())*2-1')} AS u FROM pts")
def win4(spark, sf):
    return color.rank_uniform(X.points(spark, sf), "y", "id", "u").select("id", R("u").alias("u"))


@query("win5_leading_bytes", W(SHARDS) + "SELECT level, band, sum(bytes)::BIGINT AS bytes, (sum(sum(bytes)) OVER (PARTITION BY level ORDER BY band))::BIGINT AS leading_bytes FROM shards GROUP BY 1,2")
def win5(spark, sf):
    return metrics.storage_rollup(X.shard_rows(spark, sf)).select("level", "band", "bytes", "leading_bytes")


@query("win6_first_per_id", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def win6(spark, sf):
    o = X.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return clean.first_per_id(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win7_class_size", "SELECT * FROM (SELECT o_orderkey, o_custkey, (count(*) OVER (PARTITION BY o_custkey))::BIGINT AS class_size FROM orders) WHERE class_size>=10")
def win7(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return clean.class_size_at_least(o, "o_custkey", 10).select("o_orderkey", "o_custkey", "class_size")


_EDGE = "(0,0.0::DOUBLE,5.0::DOUBLE),(1,5,10),(2,10,25),(3,25,50),(4,50,100),(5,100,250),(6,250,500),(7,500,1000),(8,1000,1e300)"
_ERR = (f"e(bin,lo,hi) AS (VALUES {_EDGE}), p AS (SELECT l_orderkey, l_linenumber, l_extendedprice/1000 AS truth, l_extendedprice/1000+l_quantity-25 AS wide, "
        "l_extendedprice/1000+(l_quantity-25)*(CASE WHEN (l_partkey%1200)<100 THEN 2 ELSE 0.5 END) AS narrow, (l_partkey%1200)::DOUBLE AS km, l_returnflag AS k FROM lineitem)")


def errors(spark, sf):
    t = F.col("l_extendedprice") / 1000
    km = (F.col("l_partkey") % 1200).cast("double")
    return X.table(spark, sf, "lineitem").select(
        t.alias("truth"), (t + F.col("l_quantity") - 25).alias("wide"),
        (t + (F.col("l_quantity") - 25) * F.when(km < 100, 2).otherwise(0.5)).alias("narrow"), km.alias("km"), F.col("l_returnflag").alias("k"))


def _skill(pred):
    return (f"SELECT k, bin, count(*)::BIGINT AS n, 1-avg((truth-{pred})*(truth-{pred}))/any_value(vp) AS skill FROM (SELECT *, var_pop(truth) OVER (PARTITION BY k) AS vp FROM p) "
            "JOIN e ON km>=lo AND km<hi GROUP BY 1,2")


@query("agg12_distance_bins", W(_ERR) + f"SELECT k, bin, coalesce(n,0)::BIGINT AS n, CASE WHEN n>=30 THEN {r('skill')} END AS skill FROM "
       f"(SELECT k, bin FROM (SELECT DISTINCT k FROM p), e) LEFT JOIN ({_skill('wide')}) USING (k, bin)")
def agg12(spark, sf):
    return metrics.binned_skill(errors(spark, sf), ["k"], pred="wide").select("k", "bin", "n", R("skill").alias("skill"))


@query("win8_first_crossing", W(_ERR) + f"SELECT n.k, min(n.bin)::INT AS bin FROM ({_skill('narrow')}) n JOIN ({_skill('wide')}) w ON n.k=w.k AND n.bin=w.bin WHERE n.n>=30 AND n.skill>w.skill GROUP BY 1")
def win8(spark, sf):
    e = errors(spark, sf)
    bins = None
    for name in ("narrow", "wide"):
        b = metrics.binned_skill(e, ["k"], pred=name).withColumn("encoder", F.lit(name))
        bins = b if bins is None else bins.unionByName(b)
    return metrics.first_crossing(bins, "narrow", "wide", ["k"]).select("k", "bin")


@query("srt1_hilbert_order")
def srt1(spark, sf):
    """Files along the curve: key range and row count per written file."""
    path = shared_dir(spark, "curve")
    p = X.points(spark, sf).withColumn("h", geo.hilbert_key("lat", "lon"))
    files.spatial_layout(p, partitions=4).write.parquet(path)
    f = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"))
    return f.select("lo", "hi", "n")


@query("srt2_row_limit", "SELECT least(1000, count(*))::BIGINT AS n FROM lineitem")
def srt2(spark, sf):
    return X.table(spark, sf, "lineitem").select("l_orderkey").limit(1000).agg(F.count(F.lit(1)).alias("n"))


@query("set1_union", W(PTS) + "SELECT split, count(*)::BIGINT AS n, count(score)::BIGINT AS scored FROM (SELECT 'trainval' AS split, NULL::DOUBLE AS score FROM pts WHERE id%5<>0 "
       "UNION ALL SELECT 'test', y FROM pts WHERE id%5=0) GROUP BY 1")
def set1(spark, sf):
    p = X.points(spark, sf)
    a = p.where(F.col("id") % 5 != 0).select("id", F.lit("trainval").alias("split"))
    b = p.where(F.col("id") % 5 == 0).select("id", F.lit("test").alias("split"), F.col("y").alias("score"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


@query("set2_cohort", W(RESULTS) + "SELECT cell_deg AS value, benchmark FROM results GROUP BY 1,2 HAVING count(DISTINCT (seed,encoder))=15")
def set2(spark, sf):
    d = X.results(spark, sf).withColumnsRenamed({"encoder": "method", "cell_deg": "value"})
    return summary.cohort_of(d, 5, 3).select("value", "benchmark")


@query("set3_difference", W(PTS) + f"SELECT DISTINCT {r('lat')} AS lat, {r('lon')} AS lon FROM pts WHERE cls<>'BUILDING'")
def set3(spark, sf):
    p = X.points(spark, sf)
    c = lambda d: d.select("lat", "lon").distinct()
    return c(p).join(c(p.where(F.col("cls") == "BUILDING")), ["lat", "lon"], "left_anti").select(R("lat").alias("lat"), R("lon").alias("lon"))


@query("set4_distinct_cells", W(PTS) + "SELECT DISTINCT floor(lat/20)::BIGINT AS cell_lat, floor(lon/20)::BIGINT AS cell_lon FROM pts")
def set4(spark, sf):
    a, b = geo.grid_cell("lat", "lon", 20.0)
    return X.points(spark, sf).select(a.alias("cell_lat"), b.alias("cell_lon")).distinct()


# --------------------------------------------------------------------------- summaries and cells

_SUM = W(RESULTS).rstrip() + """, t AS (SELECT seed, encoder AS method, cell_deg AS value, benchmark, family, avg(greatest(score,-1.0)) AS s FROM results GROUP BY 1,2,3,4,5),
 c AS (SELECT value, benchmark FROM t GROUP BY 1,2 HAVING count(DISTINCT (seed,method))=15), k AS (SELECT t.* FROM t JOIN c USING (value, benchmark)),
 ps AS (SELECT method, value, seed, 'all' AS family, avg(s) AS s, count(*) AS n FROM k GROUP BY 1,2,3 UNION ALL SELECT method, value, seed, family, avg(s), count(*) FROM k GROUP BY 1,2,3,4)
 SELECT method, 'regression' AS task_type, family, value, """ + f"{r('avg(s)')} AS mean, {r('stddev_samp(s)')} AS std, max(n)::BIGINT AS n_benchmarks, " + ", ".join(
    r(f"max(s) FILTER (seed={i})") + f" AS seed_{i}" for i in range(5)) + " FROM ps GROUP BY 1,3,4"


@query("agg6_macro_summary", _SUM)
def agg6(spark, sf):
    rows = X.results(spark, sf).withColumnsRenamed({"encoder": "method", "cell_deg": "value"}).withColumn("score", floor_score("score"))
    s = summary.summarize(rows, seeds=range(5), values=X.CELLS, methods=X.METHODS, categories=True, check=False)
    return s.select("method", "task_type", "family", "value", R("mean").alias("mean"), R("std").alias("std"), F.col("n_benchmarks").cast("long").alias("n_benchmarks"),
                    *[R(f"seed_{i}").alias(f"seed_{i}") for i in range(5)])


@query("agg18_coarsen_mask", W(CELLROWS) + f"SELECT row//8 AS row, col//8 AS col, bool_or(valid) AS land, {r('avg(lat)')} AS lat, {r('avg(lon)')} AS lon FROM cells GROUP BY 1,2")
def agg18(spark, sf):
    return metrics.coarsen_mask(X.cell_rows(spark, sf), 3).select("row", "col", "land", R("lat").alias("lat"), R("lon").alias("lon"))


@query("agg20_cell_overview", W(VECS).rstrip() + ", l AS (SELECT floor(lat/30)::BIGINT AS cell_lat, floor(lon/30)::BIGINT AS cell_lon, id, unnest(v) AS x, generate_subscripts(v,1) AS j FROM vecs), "
       "m AS (SELECT cell_lat, cell_lon, j, avg(x) AS x, count(*) AS n FROM l GROUP BY 1,2,3) SELECT cell_lat, cell_lon, any_value(n)::BIGINT AS n, " + r("sum(x)") + " AS total, " + r("sum(x*x)") + " AS sq FROM m GROUP BY 1,2")
def agg20(spark, sf):
    d = metrics.cell_overview(X.vectors(spark, sf), "v", 30.0)
    return d.select("cell_lat", "cell_lon", "n", R(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)).alias("total"), R(V.squared_norm("mean")).alias("sq"))


@query("agg21_storage_rollup", W(SHARDS) + "SELECT level, band, sum(bytes)::BIGINT AS bytes, count(*) FILTER (bytes>0)::BIGINT AS present, count(*)::BIGINT AS shards FROM shards GROUP BY 1,2")
def agg21(spark, sf):
    return metrics.storage_rollup(X.shard_rows(spark, sf)).select("level", "band", "bytes", "present", "shards")
