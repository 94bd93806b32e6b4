"""Queries for folds, samples, draws, blocks and the training-point build."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import geo
from ..operators import folds as FO
from ..operators.primitives import fixed_sample
from ..plans import normalize
from ..session import shared_dir
from .core import PTS, R, W, query
from .relational import folded
from .scalars import cities


@query("smp1_spatial_folds", W(PTS).rstrip() + ", c AS (SELECT DISTINCT floor(lat/10)::BIGINT AS a, floor(lon/10)::BIGINT AS b FROM pts), f AS (SELECT a, b, ((row_number() OVER (ORDER BY a, b)-1)%5)::INT AS fold FROM c) "
       "SELECT id, fold FROM pts JOIN f ON floor(lat/10)=a AND floor(lon/10)=b")
def smp1(spark, sf):
    return FO.spatial_folds(X.points(spark, sf), cell_deg=10.0, order="lex").select("id", "fold")


@query("smp1_spatial_folds_seeded")
def smp1b(spark, sf):
    d = FO.spatial_folds(X.points(spark, sf), cell_deg=10.0, seed=3)
    a, b = geo.grid_cell("lat", "lon", 10.0)
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(a, b).alias("cells"))


@query("smp2_modulo_folds", W(PTS) + "SELECT id, ((row_number() OVER (ORDER BY id)-1)%5)::INT AS fold FROM pts")
def smp2(spark, sf):
    return FO.modulo_folds(X.points(spark, sf), "id").select("id", "fold")


@query("smp2_random_fold_sizes", "SELECT i::INT AS fold, (n//5 + CASE WHEN i<n%5 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT count(*) AS n FROM customer), range(5) t(i)")
def smp2b(spark, sf):
    return FO.random_folds(X.points(spark, sf), "id", seed=7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("smp3_inner_bucket_sizes", W(PTS).rstrip() + ", s AS (SELECT id%5 AS fold, count(*) AS n FROM pts GROUP BY 1) SELECT fold::INT AS fold, i::INT AS bucket, "
       "(n//5 + CASE WHEN i<n%5 THEN 1 ELSE 0 END)::BIGINT AS n FROM s, range(5) t(i)")
def smp3(spark, sf):
    return FO.inner_buckets(folded(spark, sf), "id", seed=1).groupBy("fold", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("smp4_stratified_sizes", W(PTS).rstrip() + ", s AS (SELECT cls, count(*) AS n FROM pts GROUP BY 1) SELECT cls, i::INT AS fold, (n//5 + CASE WHEN i<n%5 THEN 1 ELSE 0 END)::BIGINT AS n FROM s, range(5) t(i)")
def smp4(spark, sf):
    return FO.stratified_folds(X.points(spark, sf), "id", "cls", seed=1).groupBy("cls", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("smp5_matched_deletion", W(PTS) + "SELECT (id%5)::INT AS fold, (count(*)-(id%5)*3)::BIGINT AS kept FROM pts GROUP BY id%5")
def smp5(spark, sf):
    d = folded(spark, sf)
    gone = d.select("fold").distinct().withColumn("n_removed", F.col("fold") * 3)
    return FO.matched_deletion(d, gone, "id", keys=("fold",), seed=2).groupBy("fold").agg(F.count_if("kept").alias("kept"))


@query("smp6_sphere_points")
def smp6(spark, sf):
    return FO.sphere_points(X.points(spark, sf).select("id"), "id", seed=4).select("id", R("lat").alias("lat"), R("lon").alias("lon"))


@query("smp7_weighted_draws")
def smp7(spark, sf):
    """One draw per customer among the cities, weighted by the root of the population."""
    d = FO.weighted_draws(cities(spark, sf).withColumn("w", F.sqrt("population")), X.points(spark, sf).select(F.col("id").alias("draw")),
                          id_col="city", weight="w", draw_col="draw", seed=5)
    return d.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("smp8_land_anchors")
def smp8(spark, sf):
    d = FO.land_anchors(X.points(spark, sf).select("id"), "id", X.polygons(spark), seed=6)
    return d.select("id", R("lat").alias("lat"), R("lon").alias("lon"))


@query("smp9_land_offsets")
def smp9(spark, sf):
    p = X.points(spark, sf).withColumn("lag_km", (100 + F.col("id") % 900).cast("double"))
    return FO.land_offsets(p, "id", X.polygons(spark), seed=6).select("id", "attempt", R("lat").alias("lat"), R("lon").alias("lon"))


@query("smp10_fixed_sample", W(PTS) + "SELECT (id%5)::INT AS fold, least(40,count(*))::BIGINT AS n FROM pts GROUP BY 1")
def smp10(spark, sf):
    return fixed_sample(folded(spark, sf), 40, ["id"], group=["fold"], seed=8).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def grid_pixel(lat, lon):
    """Fractional (row, col) on a one-degree grid from 84 north, 180 west."""
    return (84.0 - lat) - 0.5, (lon + 180.0) - 0.5


def grid_lonlat(row, col):
    return col + 0.5 - 180.0, 84.0 - (row + 0.5)


def mosaic(spark, sf):
    """Three-year, four-band mosaic of 144 by 360 pixels in 12 by 12 tiles, valued by the orders per cell."""
    n = X.cell_rows(spark, sf).select("row", "col", "n", "valid")
    c = n.select("*", F.explode(F.array(*[F.lit(y) for y in (2017, 2018, 2019)])).alias("year"))
    band = lambda b: ((F.col("row") * 31 + F.col("col") * 17 + F.col("n") * 7 + F.col("year") + b * 29) % 255 - 127).cast("tinyint")
    px = F.when(F.col("valid") | (F.col("year") > 2017), F.array(*[band(b) for b in range(4)])).otherwise(F.array_repeat(F.lit(-128).cast("tinyint"), 4))
    c = c.select("year", F.floor(F.col("row") / 12).alias("tile_row"), F.floor(F.col("col") / 12).alias("tile_col"),
                 ((F.col("row") % 12) * 12 + F.col("col") % 12).cast("int").alias("i"), px.alias("px"))
    t = c.groupBy("year", "tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("i", "px"))).alias("m"))  # at most 144 cells
    gap = F.array_repeat(F.lit(-128).cast("tinyint"), 4)
    return t.select("year", "tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.coalesce(F.try_element_at("m", i), gap)).alias("pixels"))


def blocks(spark, sf):
    d = X.points(spark, sf).withColumn("box", F.struct((F.col("lon") - 5).alias("west"), (F.col("lat") - 5).alias("south"), (F.col("lon") + 5).alias("east"), (F.col("lat") + 5).alias("north")))
    return FO.block_origins(d, "id", height=144, width=360, block_px=12, box="box", chunk_px=12, pixel=grid_pixel, seed=9).select("id", "row0", "col0")


@query("smp11_block_origins")
def smp11(spark, sf):
    return blocks(spark, sf)


@query("smp12_sample_blocks")
def smp12(spark, sf):
    d = FO.sample_blocks(blocks(spark, sf), mosaic(spark, sf), per_block=5, years=3, key="id", tile=12, seed=9)
    return d.select("id", "row", "col", F.size("targets").alias("years"), F.aggregate(F.flatten("targets"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("mdl20_training_points")
def mdl20(spark, sf):
    """Cities, one draw per part, blocks, pixels, shards and the two tables; then the checked join."""
    from ..operators import joins

    out = shared_dir(spark, "build")
    draws = X.table(spark, sf, "part").select(F.col("p_partkey").alias("draw"))
    teach, ann = normalize.build_training_points(
        cities(spark, sf), draws, mosaic(spark, sf), out, years=(2017, 2018, 2019), height=144, width=360, tile=12, per_block=4,
        pixel=grid_pixel, unpixel=grid_lonlat, teachers={"ta": X.demo_weights(16, 1, 8), "tb": X.demo_weights(8, 1, 8)})
    j = joins.join_annual(spark.read.parquet(teach), spark.read.parquet(ann), ["ta", "tb"])
    return j.select("point_id", R("bbox.xmin", 3).alias("lon"), R("bbox.ymin", 3).alias("lat"), F.size("aef_mean").alias("dim"))
