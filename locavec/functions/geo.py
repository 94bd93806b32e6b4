"""Geospatial column functions. Latitudes and longitudes are degrees, distances kilometres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.primitives import _c, hash_normal, hash_uniform

# Sphere radius, Equal-Earth polynomial and scale, mosaic affine, year encoding.
EARTH_RADIUS_KM = 6371.0
EQUAL_EARTH_POLY = (1.340264, -0.081106, 0.000893, 0.003796)
EQUAL_EARTH_SCALE = 66.50336
MOSAIC_LON_ORIGIN = -180.0
MOSAIC_LAT_ORIGIN = 83.68570533713473
MOSAIC_PIXEL_DEG = 0.00008983111749910169
MOSAIC_CHUNK_PX = 256
YEAR_REFERENCE = 2021.0
YEAR_SCALE = 4.0
YEAR_FREQUENCIES = 8
POLE_MARGIN_DEG = 0.05


def raw_features(lat, lon) -> Column:
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.array(F.sin(la), F.cos(la), F.sin(lo), F.cos(lo))


def unit_xyz(lat, lon) -> Column:
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.array(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def equal_earth(lat, lon) -> Column:
    """Scaled Equal-Earth coordinates as ``array(x, y)``."""
    a1, a2, a3, a4 = EQUAL_EARTH_POLY
    t = F.asin(F.lit(math.sqrt(3.0) / 2.0) * F.sin(F.radians(_c(lat))))
    t2 = t * t
    t6 = t2 * t2 * t2
    slope = F.lit(a1) + 3 * a2 * t2 + t6 * (F.lit(7 * a3) + 9 * a4 * t2)
    x = F.lit(2.0 / math.sqrt(3.0)) * F.radians(_c(lon)) * F.cos(t) / slope
    y = t * (F.lit(a1) + a2 * t2 + t6 * (F.lit(a3) + a4 * t2))
    k = EQUAL_EARTH_SCALE / 180.0
    return F.array(x * k, y * k)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    la1, la2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_dlat = (la2 - la1) / 2
    half_dlon = F.radians(_c(lon2) - _c(lon1)) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def chord_to_km(chord) -> Column:
    """Great-circle length of a unit-sphere chord."""
    half = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(chord) / 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(half)


def km_to_chord(km: float) -> float:
    return 2.0 * math.sin(min(km / (2.0 * EARTH_RADIUS_KM), math.pi / 2))


def pixel_to_lonlat(row, col) -> tuple[Column, Column]:
    """Pixel-centre (lon, lat)."""
    return (
        F.lit(MOSAIC_LON_ORIGIN) + (_c(col) + 0.5) * MOSAIC_PIXEL_DEG,
        F.lit(MOSAIC_LAT_ORIGIN) - (_c(row) + 0.5) * MOSAIC_PIXEL_DEG,
    )


def lonlat_to_pixel(lat, lon) -> tuple[Column, Column]:
    """Fractional (row, col)."""
    return (
        (F.lit(MOSAIC_LAT_ORIGIN) - _c(lat)) / MOSAIC_PIXEL_DEG - 0.5,
        (_c(lon) - MOSAIC_LON_ORIGIN) / MOSAIC_PIXEL_DEG - 0.5,
    )


def nearest_pixel(lat, lon, height: int, width: int) -> tuple[Column, Column]:
    """Half-even rounding, clamped to the array."""
    row, col = lonlat_to_pixel(lat, lon)
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(F.lit(hi - 1), F.rint(v).cast("long")))
    return clamp(row, height), clamp(col, width)


def grid_cell(lat, lon, cell_deg: float) -> tuple[Column, Column]:
    """(cell_lat, cell_lon) by floor, so negative coordinates round down."""
    return (
        F.floor(_c(lat) / F.lit(float(cell_deg))).cast("long"),
        F.floor(_c(lon) / F.lit(float(cell_deg))).cast("long"),
    )


def hilbert_key(lat, lon, bits: int = 16) -> Column:
    """Position along a Hilbert curve over a 2^bits by 2^bits grid.

    Whole batches go through the loop over bits together; a fold over an array would be interpreted row by row.
    """
    @F.pandas_udf("long")
    def key(lat: pd.Series, lon: pd.Series) -> pd.Series:
        side = (1 << bits) - 1
        at = lambda v: np.fmax(0.0, np.fmin(float(side), v)).astype("i8")  # a missing value counts as the end of the grid
        x, y = at((lon.to_numpy("f8") + 180.0) / 360.0 * side), at((lat.to_numpy("f8") + 90.0) / 180.0 * side)
        d = np.zeros(len(x), "i8")
        for bit in reversed(range(bits)):
            s = 1 << bit
            hi_x, hi_y = (x & s) != 0, (y & s) != 0
            # quadrant number along the curve: (0,0)=0, (0,1)=1, (1,1)=2, (1,0)=3
            quadrant = np.where(hi_x, np.where(hi_y, 2, 3), np.where(hi_y, 1, 0))
            # keep only the bits below s, mirroring in quadrant 3
            x, y = x & (s - 1), y & (s - 1)
            x, y = np.where(quadrant == 3, s - 1 - x, x), np.where(quadrant == 3, s - 1 - y, y)
            x, y = np.where(hi_y, x, y), np.where(hi_y, y, x)
            d += s * s * quadrant
        return pd.Series(d)

    return key(_c(lat).cast("double"), _c(lon).cast("double"))


@F.pandas_udf(T.BinaryType())
def wkb_point(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """Little-endian WKB point, x = lon and y = lat."""
    rows = np.zeros(len(lat), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))  # 21 bytes a point
    rows["order"] = rows["kind"] = 1
    rows["x"], rows["y"] = lon.to_numpy("f8"), lat.to_numpy("f8")
    data = rows.tobytes()
    return pd.Series([data[i:i + 21] for i in range(0, len(data), 21)])


def bbox_struct(lat, lon) -> Column:
    x, y = _c(lon).cast("double"), _c(lat).cast("double")
    return F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def wrap_lon(lon) -> Column:
    """Into [-180, 180)."""
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def geodesic_offset(lat, lon, km, bearing) -> tuple[Column, Column]:
    """(lat, lon) reached after ``km`` along ``bearing`` radians on the sphere."""
    d = _c(km) / EARTH_RADIUS_KM if isinstance(km, (str, Column)) else F.lit(float(km) / EARTH_RADIUS_KM)
    p1, l1, b = F.radians(_c(lat)), F.radians(_c(lon)), _c(bearing)
    s2 = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b)))
    l2 = l1 + F.atan2(F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * s2)
    return F.degrees(F.asin(s2)), wrap_lon(F.degrees(l2))


def random_bearing(*keys, seed: int = 0, stream: int = 0) -> Column:
    return hash_uniform(*keys, seed=seed, stream=stream) * F.lit(2 * math.pi)


def ring_points(df: DataFrame, k: int, radius_deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each row as member 0 plus ``k`` ring members; adds ``member``."""
    m = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(k))))
    ang = (F.col("member") - 1) * F.lit(2 * math.pi / max(k, 1))
    centre = F.col("member") == 0
    return m.withColumn(
        lat, F.when(centre, F.col(lat)).otherwise(F.col(lat) + F.lit(radius_deg) * F.sin(ang))
    ).withColumn(lon, F.when(centre, F.col(lon)).otherwise(F.col(lon) + F.lit(radius_deg) * F.cos(ang)))


def jitter_points(df: DataFrame, k: int, sigma_deg: float, key: str, *, seed: int = 0,
                  lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each row as member 0 plus ``k`` Gaussian-jittered members; adds ``member``."""
    m = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(k))))
    shift = lambda s: F.when(F.col("member") == 0, F.lit(0.0)).otherwise(
        F.lit(sigma_deg) * hash_normal(key, "member", seed=seed, stream=s)
    )
    return m.withColumn(lat, F.col(lat) + shift(1)).withColumn(lon, F.col(lon) + shift(2))


def city_bbox(lat, lon, population) -> Column:
    """Box struct (west, south, east, north) whose radius grows with the root of population."""
    la, lo = _c(lat), _c(lon)
    r = F.greatest(F.lit(2.0), F.least(F.lit(25.0), 2.0 * F.sqrt(_c(population) / 1e5)))
    dlat = r / 111.0
    dlon = r / (111.0 * F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.cos(F.radians(la)))))
    return F.struct(
        (lo - dlon).alias("west"), (la - dlat).alias("south"), (lo + dlon).alias("east"), (la + dlat).alias("north")
    )


def year_features(year, frequencies: int = YEAR_FREQUENCIES) -> Column:
    t = (_c(year).cast("double") - YEAR_REFERENCE) / YEAR_SCALE
    angles = [t * float(2**i) for i in range(frequencies)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def grid_rowcol(lat, lon, *, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
                height: int, width: int, lat_descending: bool = True) -> tuple[Column, Column]:
    """Row and column of the cell that holds a coordinate, clamped to the grid."""
    la, lo = _c(lat), _c(lon)
    down = (F.lit(lat_max) - la) if lat_descending else (la - lat_min)
    r = F.floor(down / (lat_max - lat_min) * height).cast("long")
    c = F.floor((lo - lon_min) / (lon_max - lon_min) * width).cast("long")
    return (
        F.least(F.lit(height - 1), F.greatest(F.lit(0), r)),
        F.least(F.lit(width - 1), F.greatest(F.lit(0), c)),
    )


def harmonics_matrix(lat: np.ndarray, lon: np.ndarray, degrees: int) -> np.ndarray:
    """Real spherical harmonics of degree 0..degrees-1, degree-major, order -l..l."""
    la = np.clip(np.asarray(lat, "f8"), -90 + POLE_MARGIN_DEG, 90 - POLE_MARGIN_DEG)
    theta, phi = np.radians(la + 90.0), np.radians(np.asarray(lon, "f8") + 180.0)
    x, u = np.cos(theta), np.sin(theta)
    out = np.empty((len(la), degrees * degrees))
    sectoral = np.full(len(la), math.sqrt(1.0 / (4.0 * math.pi)))
    for m in range(degrees):
        if m:
            sectoral = sectoral * u * math.sqrt((2 * m + 1) / (2 * m))
        older, newer = np.zeros_like(x), sectoral
        for ell in range(m, degrees):
            if ell > m:
                a = math.sqrt((4 * ell * ell - 1) / (ell * ell - m * m))
                b = math.sqrt(((ell - 1) ** 2 - m * m) / (4 * (ell - 1) ** 2 - 1)) if ell > m + 1 else 0.0
                older, newer = newer, a * (x * newer - b * older)
            mid = ell * ell + ell
            if m == 0:
                out[:, mid] = math.pi * newer
            else:
                out[:, mid + m] = math.sqrt(2.0) * newer * np.cos(m * phi)
                out[:, mid - m] = math.sqrt(2.0) * newer * np.sin(m * phi)
    return out


def spherical_harmonics(degrees: int):
    """Vectorized column function ``f(lat, lon) -> array<double>`` with degrees^2 values."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(list(harmonics_matrix(lat.to_numpy(), lon.to_numpy(), degrees)))

    return features
