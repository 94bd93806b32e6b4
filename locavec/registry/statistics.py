"""Queries for moments, cross products, metrics, spectra and percentiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import encoders, geo
from ..functions import vectors as V
from ..operators import metrics, models, stats
from ..operators import neighbours as NB
from ..operators.primitives import value_rank
from ..session import shared_dir
from .core import ANN, PTS, R, UNIT, VECS, W, XYZ, query, r
from .relational import _KM, errors, folded

_LONG = "l AS (SELECT id, cls, unnest(v) AS x, generate_subscripts(v,1) AS j FROM vecs)"


@query("agg1_moments", W(VECS, _LONG) + f"SELECT (j-1)::INT AS dim, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std FROM l GROUP BY 1")
def agg1(spark, sf):
    m = stats.moments(X.vectors(spark, sf), "v")
    return m.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select("dim", R("s.mean").alias("mean"), R("s.std").alias("std"))


@query("agg2_vector_mean", W(ANN, UNIT).rstrip() + ", l AS (SELECT id, unnest(u) AS x, generate_subscripts(u,1) AS j FROM unit), m AS (SELECT id, j, avg(x) AS x FROM l GROUP BY 1,2) "
       f"SELECT id AS point_id, {r('max(x) FILTER (j=1)')} AS first, {r('max(x) FILTER (j=64)')} AS last, {r('sum(x)')} AS total FROM m GROUP BY 1")
def agg2(spark, sf):
    u = X.annual(spark, sf).select("point_id", V.l2_normalize(V.dequantize("aef")).alias("u"))
    m = stats.vector_mean(u, ["point_id"], "u")
    return m.select("point_id", R(F.col("mean")[0]).alias("first"), R(F.col("mean")[63]).alias("last"), R(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("agg3_channel_scale", W(VECS, _LONG, "m AS (SELECT j, avg(x) AS mu FROM l GROUP BY 1)", "s AS (SELECT sqrt(avg((x-mu)*(x-mu))) AS rms FROM l JOIN m USING (j))") +
       f"SELECT l.id, {r('sum((x-mu)/rms)')} AS total FROM l JOIN m USING (j), s GROUP BY 1")
def agg3(spark, sf):
    d = X.vectors(spark, sf)
    mean, rms = stats.channel_scale(d, "v")
    z = F.zip_with("v", V.constant_vector(mean), lambda x, m: (x - m) / rms)
    return d.select("id", R(F.aggregate(z, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("agg4_fold_gram", W(VECS).rstrip() + ", l AS (SELECT id, id%5 AS fold, y, unnest(v) AS x, generate_subscripts(v,1) AS j FROM vecs), "
       "g AS (SELECT a.fold, a.j AS i, b.j AS j, sum(a.x*b.x) AS s FROM l a JOIN l b USING (id) GROUP BY a.fold, a.j, b.j) "
       f"SELECT fold, {r('sum(s)', 4)} AS total, {r('sum(s) FILTER (i=j)', 4)} AS trace, {r('sum(s*s)', 4)} AS sq FROM g GROUP BY 1")
def agg4(spark, sf):
    """Sum, trace and squared norm of every fold's feature cross products."""
    d = X.vectors(spark, sf).withColumn("fold", F.col("id") % 5)
    blocks, _ = stats.gram_stats(d, "v", ["y"], ["fold"], np.zeros(65))
    x = blocks.where("bi = 0 and bj = 0").select("fold", F.posexplode("cells").alias("p", "c"))
    i, j = F.floor(F.col("p") / 66), F.col("p") % 66
    x = x.where((i >= 1) & (i <= 64) & (j >= 1) & (j <= 64))
    return x.groupBy("fold").agg(R(F.sum("c"), 4).alias("total"), R(F.sum(F.when(i == j, F.col("c"))), 4).alias("trace"), R(F.sum(F.col("c") * F.col("c")), 4).alias("sq"))


@query("agg5_scores", "SELECT k, " + r("1-sum((t-p)*(t-p))/greatest(var_pop(t)*count(*),1e-12)") + " AS r2, " + r("avg(CASE WHEN q=o THEN 1.0 ELSE 0 END)") +
       " AS accuracy FROM (SELECT l_returnflag AS k, l_extendedprice/1000 AS t, l_extendedprice/1000+l_quantity-25 AS p, l_linenumber AS q, (l_orderkey%7)+1 AS o FROM lineitem) GROUP BY 1")
def agg5(spark, sf):
    a = metrics.r2_by(errors(spark, sf), ["k"], pred="wide").select("k", R("score").alias("r2"))
    c = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("truth"), ((F.col("l_orderkey") % 7) + 1).alias("pred"))
    return a.join(metrics.accuracy_by(c, ["k"]).select("k", R("score").alias("accuracy")), "k")


_PARTS = [*((f"prefix_{w}", 0, w) for w in X.WIDTHS), *((f"band_{a}_{b}", a, b) for a, b in ((0, 8), (8, 16), (16, 32), (32, 64)))]


@query("agg7_participation_ratio", W(VECS, _LONG, "m AS (SELECT j, avg(x) AS m, stddev_pop(x)+1e-8 AS s FROM l GROUP BY 1), "
       "z AS (SELECT id, j, (x-m)/s AS z FROM l JOIN m USING (j)), c AS (SELECT a.j AS i, b.j AS j, avg(a.z*b.z) AS c FROM z a JOIN z b USING (id) GROUP BY 1,2)") +
       f"SELECT part, {r('pow(sum(c) FILTER (i=j),2)/(sum(c*c)+1e-12)')} AS ratio FROM c, (VALUES " + ", ".join(f"('{n}',{a},{b})" for n, a, b in _PARTS) +
       ") t(part,lo,hi) WHERE i>lo AND i<=hi AND j>lo AND j<=hi GROUP BY 1")
def agg7(spark, sf):
    rows = stats.spectrum_report(X.vectors(spark, sf), "v", X.WIDTHS, [(0, 8), (8, 16), (16, 32), (32, 64)])
    return spark.createDataFrame([(n, round(v, 6)) for n, v in rows], "part string, ratio double")


@query("agg8_effective_rank")
def agg8(spark, sf):
    return spark.createDataFrame([(round(stats.effective_rank(stats.gram_to_driver(X.vectors(spark, sf), "v")), 6),)], "effective_rank double")


@query("agg9_pairwise_cosine", W(VECS, "u AS (SELECT id, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) AS u FROM vecs)") +
       f"SELECT {r('avg(list_inner_product(a.u,b.u))')} AS mean_cosine, (SELECT count(*)::BIGINT FROM vecs) AS n FROM u a JOIN u b ON a.id<>b.id")
def agg9(spark, sf):
    return stats.mean_pairwise_cosine(X.vectors(spark, sf), "v").select(R("mean_cosine").alias("mean_cosine"), "n")


@query("agg10_alignment", W(VECS, "u AS (SELECT id, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) AS u FROM vecs)") +
       f"SELECT {r('avg(pow(list_distance(a.u,b.u),2))')} AS alignment FROM u a JOIN u b ON b.id=a.id+1")
def agg10(spark, sf):
    a = X.vectors(spark, sf).select("id", F.col("v").alias("va"))
    p = a.join(a.select((F.col("id") - 1).alias("id"), F.col("va").alias("vb")), "id")
    return stats.alignment(p, "va", "vb").select(R("alignment").alias("alignment"))


@query("agg10_uniformity", W(VECS, "u AS (SELECT id, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) AS u FROM vecs)") +
       f"SELECT {r('ln(avg(exp(-2*pow(list_distance(a.u,b.u),2))))')} AS uniformity FROM u a JOIN u b ON a.id<b.id")
def agg10b(spark, sf):
    return stats.uniformity(X.vectors(spark, sf), "v", "id").select(R("uniformity").alias("uniformity"))


_REC = "p AS (SELECT list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) AS p, list_transform(w, lambda x: x/sqrt(list_inner_product(w,w))) AS t FROM (SELECT v, list_transform(v, lambda x: round(x,1)+0.01) AS w FROM vecs))"


@query("agg11_reconstruction", W(VECS, _REC) + f"SELECT {r('avg(list_inner_product(p,t))')} AS cosine, {r('avg(pow(list_distance(p,t),2)/64)')} AS mse FROM p")
def agg11(spark, sf):
    d = X.vectors(spark, sf).withColumn("w", F.transform("v", lambda x: F.round(x, 1) + 0.01))
    return stats.reconstruction(d, "v", "w").select(R("cosine").alias("cosine"), R("mse").alias("mse"))


@query("agg11_variance_covariance", W(VECS, _LONG, "m AS (SELECT j, avg(x) AS mu FROM l GROUP BY 1)", "c AS (SELECT l.id, l.j, x-mu AS z FROM l JOIN m USING (j))",
       "k AS (SELECT a.j AS i, b.j AS j, sum(a.z*b.z)/((SELECT count(*) FROM vecs)-1) AS s FROM c a JOIN c b USING (id) GROUP BY 1,2)") +
       "SELECT " + r("(SELECT avg(greatest(0,1-sqrt(s+1e-4))) FROM k WHERE i=j)+0.04*(SELECT sum(s*s)/64 FROM k WHERE i<>j)") + " AS penalty")
def agg11b(spark, sf):
    return spark.createDataFrame([(round(stats.variance_covariance_penalty(X.vectors(spark, sf), "v"), 6),)], "penalty double")


@query("agg13_percentiles", " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {r(f'quantile_cont(o_totalprice,{q})', 4)} AS value FROM orders" for q in (0.02, 0.5, 0.98)))
def agg13(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return stats.percentiles(o, "o_totalprice", "o_orderkey", [0.02, 0.5, 0.98]).select("q", R("value", 4).alias("value"))


@query("agg13_floor_percentiles", "WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey)-1 AS k, count(*) OVER () AS n FROM orders) "
       "SELECT max(x) FILTER (k=floor(0.02*(n-1))) AS p2, max(x) FILTER (k=floor(0.98*(n-1))) AS p98 FROM s")
def agg13b(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return spark.createDataFrame([tuple(stats.floor_percentiles(o, "o_totalprice", "o_orderkey", [0.02, 0.98]))], "p2 double, p98 double")


@query("agg14_fold_median", W(PTS, XYZ, f"d AS (SELECT a.id, a.fold, min({_KM}) AS km FROM xyz a JOIN xyz b ON a.fold<>b.fold GROUP BY 1,2)") +
       f"SELECT {r('avg(m)', 4)} AS median_nn_km, count(*)::BIGINT AS n_folds FROM (SELECT fold, quantile_cont(km,0.5) AS m FROM d GROUP BY 1)")
def agg14(spark, sf):
    return metrics.fold_median_km(NB.nearest_train_km(folded(spark, sf))).select(R("median_nn_km", 4).alias("median_nn_km"), "n_folds")


#: Every row is paired with the rows this many places on (by id, round the end), and pairs are binned by distance.
_SHIFTS = (1, 2, 3, 5, 8, 13, 21, 34)
_CURVE = ("e AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS a, cos(radians(lat))*sin(radians(lon)) AS b, sin(radians(lat)) AS z, row_number() OVER (ORDER BY id)-1 AS k, count(*) OVER () AS n FROM vecs), "
          f"pr AS (SELECT p.v AS u, q.v AS w, 2*6371.0*asin(least(1.0,sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.z-q.z)*(p.z-q.z))/2)) AS km FROM e p, (SELECT unnest({list(_SHIFTS)}) AS s) JOIN e q ON q.k=(p.k+s)%p.n), "
          "c AS (SELECT width, exp((floor(ln(km)/0.4)+0.5)*0.4) AS lag_km, 0.5*avg(list_sum(list_transform(range(1,width+1), lambda i: (u[i]-w[i])*(u[i]-w[i])))) AS gamma FROM pr, (VALUES (8),(64)) t(width) WHERE km>1 GROUP BY 1,2)")


@query("agg15_variogram")
def agg15(spark, sf):
    return variogram(spark, sf)


def variogram(spark, sf):
    """Vectors moved 10 to 5000 km: semivariance by lag and prefix, sill and half-sill."""
    from ..plans import sweeps

    out = sweeps.variogram(X.vectors(spark, sf).select("id", "lat", "lon"), X.demo_weights(), polygons=X.polygons(spark), widths=X.WIDTHS,
                           lags=[float(x) for x in np.geomspace(10, 5000, 8)], pairs_per_lag=None, dim=64)
    return out.select("encoder", "width", R("lag_km").alias("lag_km"), R("gamma").alias("gamma"), R("rel_change").alias("rel_change"), "n_pairs",
                      R("sill").alias("sill"), R("half_sill_km").alias("half_sill_km"))


_S = "s AS (SELECT width, lag_km, gamma, row_number() OVER (PARTITION BY width ORDER BY lag_km) AS k, count(*) OVER (PARTITION BY width) AS n FROM c)"
_SILL = "q AS (SELECT width, quantile_cont(gamma,0.5) AS sill FROM s WHERE k>greatest(1,floor(0.75*n)) GROUP BY 1)"
_HIT = "h AS (SELECT s.width, min(k) AS i, any_value(sill) AS sill FROM s JOIN q USING (width) WHERE gamma>=0.5*sill GROUP BY 1)"


@query("agg16_half_sill", W(VECS, _CURVE, _S, _SILL, _HIT) + f"SELECT h.width, {r('sill')} AS sill, " + r(
    "CASE WHEN i=1 THEN b.lag_km ELSE exp(ln(a.lag_km)+(0.5*sill-a.gamma)/(b.gamma-a.gamma)*(ln(b.lag_km)-ln(a.lag_km))) END", 4) +
    " AS half_sill_km FROM h JOIN s b ON b.width=h.width AND b.k=i LEFT JOIN s a ON a.width=h.width AND a.k=i-1")
def agg16(spark, sf):
    """Half-sill of the semivariance over pairs of table rows, by their distance."""
    e = value_rank(X.vectors(spark, sf).select("id", "lat", "lon", "v"), "id", "id", out="k")
    n = e.count()
    p = e.withColumn("to", F.explode(F.array(*[F.lit(s) for s in _SHIFTS]))).withColumn("to", (F.col("k") + F.col("to")) % n)
    q = e.select(F.col("k").alias("to"), F.col("v").alias("vb"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = p.join(q, "to").withColumn("km", geo.chord_to_km(V.norm(F.zip_with(geo.unit_xyz("lat", "lon"), geo.unit_xyz("lat2", "lon2"), lambda a, b: a - b)))).where("km > 1")
    lag = F.exp((F.floor(F.log("km") / 0.4) + 0.5) * 0.4)
    curve = metrics.semivariance(pairs.select(lag.alias("lag_km"), F.col("v").alias("va"), "vb"), (8, 64))
    return metrics.half_sill(curve).select("width", R("sill").alias("sill"), R("half_sill_km", 4).alias("half_sill_km"))


_NN = ("n AS (SELECT a.id AS qid, b.y, b.cls, km, rank FROM (SELECT a.id AS qid, b.id AS tid, " + _KM + " AS km, row_number() OVER (PARTITION BY a.id ORDER BY "
       "sqrt((a.x-b.x)*(a.x-b.x)+(a.yy-b.yy)*(a.yy-b.yy)+(a.z-b.z)*(a.z-b.z)), b.id) AS rank FROM xyz a JOIN xyz b ON a.fold<>b.fold) t JOIN xyz a ON a.id=t.qid JOIN xyz b ON b.id=t.tid WHERE rank<=5)")


@query("agg17_idw", W(PTS, XYZ, _NN) + f"SELECT qid, k::INT AS k, {r('sum(y/greatest(km,0.01))/sum(1/greatest(km,0.01))', 4)} AS pred FROM n, (VALUES (1),(5)) t(k) WHERE rank<=k GROUP BY 1,2")
def agg17(spark, sf):
    hits = NB.sphere_knn(folded(spark, sf), k=5, payload=("y",))
    return metrics.idw(hits, [1, 5], "y").select("qid", "k", R("pred", 4).alias("pred"))


_CODE = "nc AS (SELECT qid, km, rank, dense_rank() OVER (ORDER BY cls)-1 AS c FROM n)"


@query("agg17_weighted_vote", W(PTS, XYZ, _NN, _CODE) + "SELECT qid, 5::INT AS k, arg_max(c, (v, -c))::INT AS pred FROM (SELECT qid, c, sum(1/greatest(km,0.01)) AS v FROM nc GROUP BY 1,2) GROUP BY 1")
def agg17b(spark, sf):
    d, _ = models.class_codes(folded(spark, sf), "cls")
    return metrics.idw(NB.sphere_knn(d, k=5, payload=("cls_code",)), [5], "cls_code", "classification")


# --------------------------------------------------------------------------- encoders


@query("vec10_sine_network")
def vec10(spark, sf):
    d = encoders.embed(X.points(spark, sf), X.demo_weights(use_year=True), dim=8, year="year")
    return d.select("id", *[R(F.col("vec")[i], 4).alias(f"v{i}") for i in range(8)])


@query("vec10_harmonics_network")
def vec10b(spark, sf):
    w = {"layer0.weight": np.sin(np.arange(32 * 36) * 0.7).reshape(32, 36) / 36, "layer0.bias": np.zeros(32),
         "layer1.weight": np.sin(np.arange(32 * 32) * 1.3).reshape(32, 32) / 8, "layer1.bias": np.zeros(32),
         "last.weight": np.cos(np.arange(8 * 32) * 0.9).reshape(8, 32) / 8, "last.bias": np.zeros(8)}
    d = encoders.map_encoder(X.points(spark, sf), lambda p, la, lo: encoders.harmonics_network(p, la, lo, 6), "vec", payload=w)
    return d.select("id", *[R(F.col("vec")[i], 4).alias(f"v{i}") for i in range(8)])


@query("vec11_ring_embedding")
def vec11(spark, sf):
    d = encoders.embed_ring(X.points(spark, sf), X.demo_weights(), "id", 4, 0.1, dim=8)
    return d.select("id", *[R(F.col("vec")[i], 4).alias(f"v{i}") for i in range(8)])


@query("vec12_linear_heads")
def vec12(spark, sf):
    heads = {f"h{k}": (np.cos(np.arange(4 * 64) * k).reshape(4, 64), np.full(4, float(k))) for k in (1, 2, 3)}
    d = encoders.embed_heads(X.points(spark, sf), X.demo_weights(), heads)
    return d.select("id", F.size("vec").alias("dim"), R(F.col("vec")[0], 4).alias("first"), R(F.col("vec")[27], 3).alias("last"))


@query("vec13_embedding_cache", W(PTS) + f"SELECT id, {r('sin(radians(lat))', 5)} AS v0, 0::BIGINT AS recomputed FROM pts")
def vec13(spark, sf):
    """Fill a cache with two thirds of the coordinates, complete it, then find nothing left to compute."""
    path, p = shared_dir(spark, "cache"), X.points(spark, sf)
    enc = lambda d: encoders.EncoderRegistry().encode(d, ["raw_coords"])["raw_coords"]
    encoders.embed_cached(p.where(F.col("id") % 3 != 0), path, "raw", "v1", enc)
    encoders.embed_cached(p, path, "raw", "v1", enc)
    before = spark.read.parquet(path).count()
    d = encoders.embed_cached(p, path, "raw", "v1", enc)
    return d.select("id", R(F.col("vec")[0], 5).alias("v0"), F.lit(spark.read.parquet(path).count() - before).cast("long").alias("recomputed"))


@query("vec14_mosaic_lookup")
def vec14(spark, sf):
    from .sampling import mosaic, grid_pixel
    from ..operators import joins

    row, col = grid_pixel(F.col("lat"), F.col("lon"))
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(F.lit(hi - 1), F.rint(v).cast("long")))
    d = joins.mosaic_vectors(X.points(spark, sf), mosaic(spark, sf), height=144, width=360, tile=12, first_year=2017, last_year=2019, dim=4,
                             row=clamp(row, 144), col=clamp(col, 360))
    return d.select("id", *[R(F.when(~F.isnan(F.col("vec")[i]), F.col("vec")[i])).alias(f"v{i}") for i in range(4)])


@query("vec15_encoder_registry", W(PTS) + "SELECT id, 'raw_coords' AS encoder, 4::INT AS dim, " + r("sin(radians(lat))", 5) + " AS v0 FROM pts UNION ALL SELECT id, 'xyz_coords', 3, " +
       r("cos(radians(lat))*cos(radians(lon))", 5) + " FROM pts UNION ALL SELECT id, 'raw_coords_2', 2, " + r("sin(radians(lat))", 5) + " FROM pts")
def vec15(spark, sf):
    reg = encoders.EncoderRegistry()
    got = reg.encode(X.points(spark, sf), ["raw_coords", "xyz_coords"])
    show = lambda d, name: d.select("id", F.lit(name).alias("encoder"), F.size("vec").alias("dim"), R(F.col("vec")[0], 5).alias("v0"))
    pre = got["raw_coords"].withColumn("vec", reg.prefixes("raw_coords", "vec", [2])["raw_coords_2"])
    return show(got["raw_coords"], "raw_coords").unionByName(show(got["xyz_coords"], "xyz_coords")).unionByName(show(pre, "raw_coords_2"))
