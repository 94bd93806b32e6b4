"""Identifier, polygon and raster joins, multiset containment, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import BROADCAST_BYTES
from .stats import vector_mean

# --------------------------------------------------------------------------- teachers and annual vectors


def annual_violations(teachers: DataFrame, annual: DataFrame, vectors: Sequence[str] = ()) -> DataFrame:
    """One row of counts: every reason for which the two tables cannot be joined."""
    n_years = annual.select("year").distinct().count()
    per_id = annual.groupBy("point_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("year").alias("years"),
        F.count_if(F.col("aef").isNull() | F.exists("aef", lambda x: x.isNull())).alias("nulls"),
        F.count_if(V.has_nodata("aef")).alias("nodata"),
    )
    tid = teachers.groupBy("point_id").agg(
        F.count(F.lit(1)).alias("t_rows"),
        *[F.count_if(F.coalesce(~V.all_finite(v), F.lit(True))).alias(f"bad_{v}") for v in vectors])
    j = tid.join(per_id, "point_id", "full_outer")
    bad = sum([F.coalesce(F.sum(f"bad_{v}"), F.lit(0)) for v in vectors], F.lit(0))
    return j.agg(
        F.count_if(F.col("t_rows") > 1).alias("duplicate_points"),
        F.count_if(F.col("t_rows").isNull()).alias("orphans"),
        F.count_if(F.col("rows") > F.col("years")).alias("duplicate_years"),
        F.count_if(F.coalesce(F.col("years"), F.lit(0)) < n_years).alias("missing_years"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_vectors"),
        F.coalesce(F.sum("nodata"), F.lit(0)).alias("nodata_vectors"),
        bad.cast("long").alias("bad_teachers"),
    )


def join_annual(teachers: DataFrame, annual: DataFrame, vectors: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Teachers with the mean of their decoded, normalized annual vectors (column aef_mean)."""
    if check:
        bad = {k: v for k, v in annual_violations(teachers, annual, vectors).first().asDict().items() if v}
        if bad:
            raise ValueError(f"annual vectors do not match the teacher table: {bad}")
    unit = annual.select("point_id", V.l2_normalize(V.dequantize("aef")).alias("u"))
    return teachers.join(vector_mean(unit, ["point_id"], "u", "aef_mean").drop("n"), "point_id")


def half_precision(vec: str):
    """Vectorized rounding of an array column to half precision and back."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def half(s: pd.Series) -> pd.Series:
        have = s.notna().to_numpy()
        if not have.any():
            return s
        rows = s.to_numpy()[have]
        flat = np.concatenate(rows).astype("f2").astype("f8")  # all values of the batch at once
        out = np.full(len(s), None, object)
        out[have] = pd.Series(np.split(flat, np.cumsum([len(r) for r in rows])[:-1])).to_numpy()
        return pd.Series(out)

    return half(F.col(vec))


# --------------------------------------------------------------------------- polygons

def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly, label, rings) with rings array<array<struct<x,y>>> to (poly, label, edges, bbox)."""
    def ring_edges(r):
        nxt = F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, F.lit(1), F.lit(1)))
        return F.zip_with(r, nxt, lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    e = polygons.select("poly", "label", F.flatten(F.transform("rings", ring_edges)).alias("edges"))
    ends = lambda k: F.transform("edges", lambda p: p[k])
    return e.select(
        "*", F.array_min(ends("x1")).alias("xmin"), F.array_max(ends("x1")).alias("xmax"),
        F.array_min(ends("y1")).alias("ymin"), F.array_max(ends("y1")).alias("ymax"))


def inside(edges, x, y) -> Column:
    """Even-odd test against all rings, so holes count as outside; so does the boundary."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    odd = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
    on_edge = F.exists(edges, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))))
    return odd & ~on_edge


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell_deg: float = 5.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Inner join of points to the polygons that hold them: points' columns plus poly, label.

    Polygons are indexed by the grid cells of their boxes, clipped to the edges that matter for the
    cell, and met by equi-join. The side is broadcast only when its measured size allows; otherwise
    the cell join runs with adaptive skew splitting of the points.
    """
    fl = lambda c: F.floor(c / cell_deg).cast("long")
    e = polygon_edges(polygons)
    index = e.select("*", F.explode(F.sequence(fl(F.col("xmin")), fl(F.col("xmax")))).alias("__cx")).select(
        "*", F.explode(F.sequence(fl(F.col("ymin")), fl(F.col("ymax")))).alias("__cy"))
    # a rightward ray from any point of the cell only meets edges in the cell's rows and not wholly left of it
    lo_y, hi_y, lo_x = F.col("__cy") * cell_deg, (F.col("__cy") + 1) * cell_deg, F.col("__cx") * cell_deg
    index = index.select("poly", "label", "__cx", "__cy", F.filter("edges", lambda s: (
        (F.greatest(s["y1"], s["y2"]) >= lo_y) & (F.least(s["y1"], s["y2"]) <= hi_y) & (F.greatest(s["x1"], s["x2"]) >= lo_x)
    )).alias("edges"))
    size = index.agg(F.sum(F.size("edges") * 40 + 64)).first()[0] or 0
    side = F.broadcast(index) if size <= BROADCAST_BYTES else index
    p = points.withColumn("__cx", fl(F.col(lon))).withColumn("__cy", fl(F.col(lat)))
    return p.join(side, ["__cx", "__cy"]).where(inside(F.col("edges"), F.col(lon), F.col(lat))).drop("__cx", "__cy", "edges")


def on_land(points: DataFrame, polygons: DataFrame, id_col: str = "id", **kw) -> DataFrame:
    """Points inside any polygon, each once."""
    hits = point_in_polygon(points.select(id_col, "lon", "lat"), polygons, **kw).select(id_col).distinct()
    return points.join(hits, id_col, "left_semi")


# --------------------------------------------------------------------------- raster tiles

def sample_raster(points: DataFrame, tiles: DataFrame, *, x0: float, y0: float, dx: float, dy: float, height: int, width: int,
                  tile: int, nodata: float | None = None, x: str = "lon", y: str = "lat", out: str = "value") -> DataFrame:
    """Value of the raster cell under each point; nodata becomes null, indices are clamped.

    ``tiles`` has tile_row, tile_col and pixels (row-major array). (x0, y0) is the outer corner of the
    first cell, (dx, dy) the cell steps; x and y are in the raster's own coordinate system.
    """
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v).cast("long")))
    p = points.withColumn("__r", clamp((F.col(y) - y0) / dy, height)).withColumn("__c", clamp((F.col(x) - x0) / dx, width))
    p = p.withColumn("tile_row", F.floor(F.col("__r") / tile).cast("long")).withColumn("tile_col", F.floor(F.col("__c") / tile).cast("long"))
    at = F.pmod(F.col("__r"), F.lit(tile)) * tile + F.pmod(F.col("__c"), F.lit(tile))
    v = F.get(F.col("pixels"), at.cast("int")).cast("double")
    v = F.when(v == F.lit(nodata), None).otherwise(v) if nodata is not None else v
    t = tiles.select(F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), "pixels")
    return p.join(t, ["tile_row", "tile_col"], "left").withColumn(out, v).drop("__r", "__c", "tile_row", "tile_col", "pixels")


def mosaic_vectors(points: DataFrame, tiles: DataFrame, *, height: int, width: int, tile: int, first_year: int, last_year: int,
                   dim: int, row: Column, col: Column, out: str = "vec") -> DataFrame:
    """Decoded unit vector of the nearest mosaic pixel in the (clipped) year; NaN on nodata.

    ``tiles``: year, tile_row, tile_col, pixels array<array<tinyint>> (row-major cells).
    """
    p = points.withColumn("__y", F.greatest(F.lit(first_year), F.least(F.lit(last_year), F.col("year"))))
    p = p.withColumn("__r", row).withColumn("__c", col)
    p = p.withColumn("tile_row", F.floor(F.col("__r") / tile).cast("long")).withColumn("tile_col", F.floor(F.col("__c") / tile).cast("long"))
    t = tiles.select(F.col("year").alias("__y"), F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), "pixels")
    at = F.pmod(F.col("__r"), F.lit(tile)) * tile + F.pmod(F.col("__c"), F.lit(tile))
    raw = F.get(F.col("pixels"), at.cast("int"))
    nan = F.array_repeat(F.lit(float("nan")), dim)
    vec = F.when(raw.isNull() | V.has_nodata(raw), nan).otherwise(V.l2_normalize(V.dequantize(raw)))
    return p.join(t, ["__y", "tile_row", "tile_col"], "left").withColumn(out, vec).drop("__y", "__r", "__c", "tile_row", "tile_col", "pixels")


# --------------------------------------------------------------------------- containment

def containment(source: DataFrame, target: DataFrame, value: str, *, numeric: bool = True, atol: float = 1e-6) -> DataFrame:
    """One row (coordinates, missing, bad): source values matched to distinct target values.

    Coordinates are rounded to six places. Equal values at a coordinate cancel by count first, which
    is combined before the shuffle, so repeated rows at one coordinate cost one row. A single value
    left open at a coordinate is settled by aggregation; only several distinct open values of one
    coordinate meet in a task.
    """
    val = F.when(F.isnan(value), None).otherwise(F.col(value)) if numeric else F.col(value).cast("string")
    key = lambda df, n: df.groupBy(F.round("lon", 6).alias("x"), F.round("lat", 6).alias("y"), val.alias("v")).agg(
        F.count(F.lit(1)).alias(n))
    s, t = key(source, "ns"), key(target, "nt")
    coords_t = t.select("x", "y").distinct()
    coords_s = s.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    total = coords_s.count()
    missing = coords_s.join(coords_t, ["x", "y"], "left_anti").count()
    left = (
        s.alias("s").join(t.alias("t"), (F.col("s.x") == F.col("t.x")) & (F.col("s.y") == F.col("t.y"))
                          & F.col("s.v").eqNullSafe(F.col("t.v")), "full_outer")
        .select(F.coalesce("s.x", "t.x").alias("x"), F.coalesce("s.y", "t.y").alias("y"), F.coalesce("s.v", "t.v").alias("v"),
                F.coalesce("ns", F.lit(0)).alias("ns"), F.coalesce("nt", F.lit(0)).alias("nt"))
        .withColumn("d", F.col("ns") - F.col("nt")).where("d != 0")
    )
    have = coords_t.withColumn("__have", F.lit(True))
    if not numeric:
        bad = left.where("d > 0").join(have, ["x", "y"]).select("x", "y").distinct().count()
        return source.sparkSession.createDataFrame([(total, missing, bad)], "coordinates long, missing long, bad long")
    short = left.where("d > 0").select("x", "y").distinct()
    rest = left.join(short, ["x", "y"], "left_semi").join(have.select("x", "y"), ["x", "y"], "left_semi")
    # one distinct open value at a coordinate: count its partners by plain aggregation
    one = rest.where("d > 0").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"), F.max("v").alias("b"), F.max("d").alias("need"))
    near = F.abs(F.col("v") - F.col("b")) <= atol + 1e-5 * F.abs(F.col("b"))
    easy = rest.where("d < 0").join(one.where("k = 1"), ["x", "y"], "right").groupBy("x", "y").agg(
        F.max("need").alias("need"), F.coalesce(F.sum(F.when(near, -F.col("d"))), F.lit(0)).alias("got"))
    bad_easy = easy.where("got < need").count()
    rest = rest.join(one.where("k > 1"), ["x", "y"], "left_semi")

    def greedy(key, pdf):
        src = pdf[pdf.d > 0].sort_values("v")
        pool = pdf[pdf.d < 0].sort_values("v")
        v, free = pool.v.to_numpy("f8"), (-pool.d).to_numpy("i8").copy()
        ok = True
        for b, need in zip(src.v.to_numpy("f8"), src.d.to_numpy("i8")):
            near = np.flatnonzero((np.abs(v - b) <= atol + 1e-5 * abs(b)) & (free > 0))
            for i in near:
                take = min(need, free[i])
                free[i] -= take
                need -= take
                if not need:
                    break
            ok &= need == 0
        return pd.DataFrame({"x": [key[0]], "y": [key[1]], "ok": [bool(ok)]})

    bad = rest.groupBy("x", "y").applyInPandas(greedy, "x double, y double, ok boolean").where("not ok").count() + bad_easy
    return source.sparkSession.createDataFrame([(total, missing, bad)], "coordinates long, missing long, bad long")


def check_containment(name: str, *args, **kw) -> None:
    r = containment(*args, **kw).first()
    if r["missing"] or r["bad"]:
        raise AssertionError(f"{name}: {r['missing']} coordinates missing, {r['bad']} with unmatched values, of {r['coordinates']}")
