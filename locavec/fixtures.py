"""Adapters from the bundled tables to located points, vectors, rasters and result rows.

No bundled table has coordinates, so they follow from integer formulas that any engine reproduces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
WIDTHS = (8, 16, 32, 64)
STARTS = (8, 16, 32)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat_of(i: Column) -> Column:
    return ((i * 7919) % 14401) / F.lit(100.0) - 60


def lon_of(i: Column) -> Column:
    return ((i * 104729) % 36000) / F.lit(100.0) - 180


def points(spark: SparkSession, sf: str) -> DataFrame:
    """id, lat, lon, y, cls, year: one located point per customer."""
    i = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        i.alias("id"), lat_of(i).alias("lat"), lon_of(i).alias("lon"), F.col("c_acctbal").alias("y"),
        F.col("c_mktsegment").alias("cls"), (2017 + i % 9).cast("int").alias("year"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, lat, lon, v, y, cls: one located vector per embedding."""
    i = F.col("vec_id")
    d = table(spark, sf, "embeddings").select(
        i.alias("id"), lat_of(i).alias("lat"), lon_of(i).alias("lon"), F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("int").alias("cls"))
    return d.withColumn("y", 3 * F.col("v")[0] - 2 * F.col("v")[1] + F.col("v")[32] + F.col("lat") / 90)


def annual(spark: SparkSession, sf: str, years=(2017, 2018, 2019)) -> DataFrame:
    """point_id, year, aef: int8 codes of each vector with a yearly step."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    y = e.withColumn("year", F.explode(F.array(*[F.lit(k) for k in years])))
    code = F.transform("v", lambda x: F.greatest(F.lit(-127.0), F.least(
        F.lit(127.0), F.signum(x) * F.floor(F.sqrt(F.abs(x)) * 127.5) + (F.col("year") - 2018))).cast("tinyint"))
    return y.select(F.col("vec_id").alias("point_id"), F.col("year").cast("smallint"), code.alias("aef"))


def teachers(spark: SparkSession, sf: str) -> DataFrame:
    """point_id, lat, lon and three vectors cut from each embedding."""
    d = vectors(spark, sf)
    return d.select(F.col("id").alias("point_id"), "lat", "lon", F.slice("v", 1, 32).alias("ta"), F.slice("v", 33, 16).alias("tb"),
                    F.slice("v", 49, 16).alias("tc"))


RASTER_HEIGHT, RASTER_WIDTH, RASTER_TILE = 180, 360, 20


def raster_value(row, col):
    return (row * 31 + col * 17) % 251


def raster_tiles(spark: SparkSession) -> DataFrame:
    """One-degree raster in 20 by 20 tiles; nodata is -1 where the value is divisible by 13."""
    n = RASTER_HEIGHT * RASTER_WIDTH // RASTER_TILE**2
    per = RASTER_WIDTH // RASTER_TILE
    t = spark.range(n).select(F.floor(F.col("id") / per).cast("long").alias("tile_row"), (F.col("id") % per).alias("tile_col"))
    cell = lambda k: (
        raster_value(F.col("tile_row") * RASTER_TILE + F.floor(k / RASTER_TILE), F.col("tile_col") * RASTER_TILE + k % RASTER_TILE))
    px = F.transform(F.sequence(F.lit(0), F.lit(RASTER_TILE**2 - 1)),
                     lambda k: F.when(cell(k) % 13 == 0, -1).otherwise(cell(k)).cast("int"))
    return t.select("tile_row", "tile_col", px.alias("pixels"))


POLYGONS = [
    (0, "west", [[(-60.0, -40.0), (0.0, -40.0), (0.0, 40.0), (-60.0, 40.0)]]),
    (1, "east", [[(0.0, -40.0), (60.0, -40.0), (60.0, 40.0), (0.0, 40.0)]]),
    (2, "tri", [[(80.0, -30.0), (140.0, -30.0), (110.0, 50.0)]]),
    (3, "ring", [[(-160.0, -50.0), (-90.0, -50.0), (-90.0, 20.0), (-160.0, 20.0)],
                 [(-140.0, -30.0), (-110.0, -30.0), (-110.0, 0.0), (-140.0, 0.0)]]),
]


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, "poly int, label string, rings array<array<struct<x:double,y:double>>>")


def polygon_edge_values() -> str:
    """The polygons' edges as SQL VALUES rows (poly, label, x1, y1, x2, y2)."""
    rows = []
    for poly, label, rings in POLYGONS:
        for r in rings:
            for (a, b), (c, d) in zip(r, r[1:] + r[:1]):
                rows.append(f"({poly},'{label}',{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE,{d}::DOUBLE)")
    return ",".join(rows)


def raw_source(spark: SparkSession, sf: str) -> DataFrame:
    """Untidy source: padded and mixed-case names, POINT text, sentinels, nulls, missing coordinates."""
    p = points(spark, sf)
    i = F.col("id")
    miss = i % 5 == 0
    return p.select(
        i.alias(" ID"), F.when(~miss, F.col("lat")).alias("Latitude"), F.when(~miss, F.col("lon")).alias("Longitude "),
        F.concat(F.lit("POINT ("), F.format_string("%.2f", "lon"), F.lit(" "), F.format_string("%.2f", "lat"), F.lit(")")).alias("Geolocation"),
        F.when(i % 17 == 0, F.lit(-999.0)).when(i % 19 == 0, None).otherwise(F.col("y")).alias("Population"),
        F.col("year").alias("Year"), F.col("cls").alias("segment"))


def cell_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fine grid cells derived from orders: row, col, lat, lon, valid, n."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        ((k * 7919) % 144).alias("row"), ((k * 104729) % 360).alias("col"), (F.col("o_orderstatus") == "O").alias("o")
    ).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.bool_or("o").alias("valid")).select(
        "row", "col", (84 - F.col("row") - 0.5).alias("lat"), (F.col("col") - 180 + 0.5).alias("lon"), "valid", "n")


def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bytes per level, band and shard, derived from lineitem; some shards hold nothing."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 4).alias("level"), (F.col("l_partkey") % 48).alias("band"), (F.col("l_suppkey") % 25).alias("shard"),
        F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("b")
    ).groupBy("level", "band", "shard").agg(F.sum("b").cast("long").alias("bytes"))


CELLS = (0.0, 2.0, 10.0, 20.0, 40.0)
METHODS = ("alpha", "beta", "gamma")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows per nation, seed, cell size, method and task, derived from orders.

    Nation 7 lacks a method, nation 3 repeats its distance between two cell sizes, some scores fall
    under the floor.
    """
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk")), "o_custkey")
    k = F.col("o_orderkey")
    g = o.groupBy("nk").agg(F.count(F.lit(1)).alias("cnt"), F.sum(k).alias("ks"))
    n = g.join(F.broadcast(table(spark, sf, "nation")), F.col("nk") == F.col("n_nationkey")).join(
        F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lit = lambda name, vals: F.explode(F.array(*[F.lit(v) for v in vals])).alias(name)
    x = n.select("nk", "cnt", "ks", F.col("n_name").alias("benchmark"), F.lower("r_name").alias("family"), lit("seed", range(5)))
    x = x.select("*", F.posexplode(F.array(*[F.lit(c) for c in CELLS])).alias("ci", "cell_deg"))
    x = x.select("*", F.posexplode(F.array(*[F.lit(m) for m in METHODS])).alias("mi", "encoder"))
    x = x.select("*", lit("t", (0, 1)))
    x = x.where(~((F.col("nk") == 7) & (F.col("mi") == 2)))
    mix = F.col("cnt") * 7 + F.col("ks") % 1009 + F.col("seed") * 37 + F.col("ci") * 53 + F.col("mi") * 71 + F.col("t") * 29
    dist = F.when((F.col("nk") == 3) & (F.col("ci") == 4), F.lit(3)).otherwise(F.col("ci"))
    return x.select(
        "benchmark", "family", F.concat(F.lit("t"), F.col("t")).alias("task"), F.lit("regression").alias("task_type"), "seed", "encoder",
        "cell_deg", ((F.col("cnt") % 100 + dist * 10) / F.lit(10.0)).alias("median_nn_train_km"),
        (((mix * 37) % 250 - 150) / F.lit(100.0)).alias("score"))


def demo_weights(width: int = 64, depth: int = 2, head: int = 16, use_year: bool = False) -> dict[str, np.ndarray]:
    """Deterministic small network weights."""
    def mat(r, c, s, k):
        return (np.sin(np.arange(r * c) * 12.9898 + k * 78.233) * s).reshape(r, c).astype("f4")

    inputs = 2 + (16 if use_year else 0)
    w = {"first.weight": mat(width, inputs, 1.0 / inputs, 1), "first.bias": mat(1, width, 0.5, 2)[0]}
    for i in range(depth):
        w[f"block{i}.weight"] = mat(width, width, (6.0 / width) ** 0.5, 3 + i)
        w[f"block{i}.bias"] = mat(1, width, 0.1, 30 + i)[0]
    w["head.weight"], w["head.bias"] = mat(head, width, 0.2, 60), mat(1, head, 0.1, 61)[0]
    return w
