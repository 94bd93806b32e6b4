"""Batch coordinate encoders: residual sine network, harmonics network, heads, registry and cache.

Weights are model-sized NumPy arrays, broadcast once and used per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import apply_linear, standardized, vector_mean
from . import geo
from . import vectors as V

Weights = dict[str, np.ndarray]
ACTIVATIONS = ("siren", "finer", "hsiren")
FIRST_FREQUENCY = 30.0


def equal_earth_matrix(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a1, a2, a3, a4 = geo.EQUAL_EARTH_POLY
    t = np.arcsin(np.sqrt(3.0) / 2.0 * np.sin(np.radians(lat)))
    t2 = t * t
    slope = a1 + 3 * a2 * t2 + t2**3 * (7 * a3 + 9 * a4 * t2)
    x = 2.0 / np.sqrt(3.0) * np.radians(lon) * np.cos(t) / slope
    y = t * (a1 + a2 * t2 + t2**3 * (a3 + a4 * t2))
    return np.column_stack([x, y]) * (geo.EQUAL_EARTH_SCALE / 180.0)


def year_matrix(year: np.ndarray, frequencies: int = geo.YEAR_FREQUENCIES) -> np.ndarray:
    ang = ((year - geo.YEAR_REFERENCE) / geo.YEAR_SCALE)[:, None] * 2.0 ** np.arange(frequencies)
    return np.hstack([np.sin(ang), np.cos(ang)])


def network_shape(w: Weights) -> dict[str, int | bool]:
    """Width, depth, head size and year use, read off the weight shapes."""
    if "first.weight" not in w:
        raise ValueError("not a residual sine network: first.weight is missing")
    width, inputs = w["first.weight"].shape
    depth = sum(k.startswith("block") and k.endswith(".weight") for k in w)
    if inputs not in (2, 2 + 2 * geo.YEAR_FREQUENCIES):
        raise ValueError(f"unexpected input size {inputs}")
    return {"width": width, "depth": depth, "head": len(w["head.weight"]) if "head.weight" in w else width, "use_year": inputs > 2}


def sine_network(w: Weights, lat: np.ndarray, lon: np.ndarray, year: np.ndarray | None = None, *, feature: str = "pooled",
                 activation: str = "siren", first_frequency: float = FIRST_FREQUENCY) -> np.ndarray:
    """Forward pass: sine first layer, residual sine blocks, optional linear head."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"unknown activation {activation!r}")
    if feature not in ("pooled", "head"):
        raise ValueError("feature must be 'pooled' or 'head'")
    shape = network_shape(w)
    x = equal_earth_matrix(lat, lon)
    if shape["use_year"]:
        if year is None:
            raise ValueError("this network needs a year")
        x = np.hstack([x, year_matrix(year)])

    def layer(name: str, h: np.ndarray, frequency: float, first: bool) -> np.ndarray:
        z = h @ w[f"{name}.weight"].T + w[f"{name}.bias"]
        if activation == "finer":
            z = (np.abs(z) + 1.0) * z
        elif activation == "hsiren" and first:
            z = np.sinh(z)
        return np.sin(frequency * z)

    h = layer("first", x.astype("f4"), first_frequency, True)
    for i in range(shape["depth"]):
        h = h + layer(f"block{i}", h, 1.0, False)
    if feature == "head" and "head.weight" in w:
        h = h @ w["head.weight"].T + w["head.bias"]
    return h


def harmonics_network(w: Weights, lat: np.ndarray, lon: np.ndarray, degrees: int) -> np.ndarray:
    """Plain sine network over spherical-harmonic features; the last layer is linear."""
    h = geo.harmonics_matrix(lat, lon, degrees)
    n = sum(k.startswith("layer") and k.endswith(".weight") for k in w)
    for i in range(n):
        h = np.sin((FIRST_FREQUENCY if i == 0 else 1.0) * (h @ w[f"layer{i}.weight"].T + w[f"layer{i}.bias"]))
    return h @ w["last.weight"].T + w["last.bias"]


def map_encoder(df: DataFrame, fn: Callable[..., np.ndarray], out: str, *, lat: str = "lat", lon: str = "lon",
                year: str | None = None, payload=None) -> DataFrame:
    """Adds ``out`` = fn(payload, lat, lon[, year]) as array<float>, batch by batch.

    Narrow and row-wise, so it also runs on a streaming DataFrame.
    """
    bc = df.sparkSession.sparkContext.broadcast(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("f8")
                args = [get(lat), get(lon)] + ([get(year)] if year else [])
                m = np.ascontiguousarray(fn(bc.value, *args), dtype="f4")
                off = (np.arange(len(m) + 1) * m.shape[1]).astype("i4")
                col = pa.ListArray.from_arrays(pa.array(off), pa.array(m.ravel()))
            else:
                col = pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embed(df: DataFrame, weights: Weights, *, dim: int | None = 64, year: str | None = None, feature: str = "pooled",
          activation: str = "siren", out: str = "vec", **cols) -> DataFrame:
    """First ``dim`` channels of the residual sine network at each coordinate."""
    shape = network_shape(weights)
    width = shape["width"] if feature == "pooled" else shape["head"]
    dim = width if dim is None else dim
    if not 0 < dim <= width:
        raise ValueError("dim must be within the embedding width")
    if shape["use_year"] and year is None:
        raise ValueError("this network needs a year column")

    def fn(w, la, lo, yr=None):
        return sine_network(w, la, lo, yr, feature=feature, activation=activation)[:, :dim]

    return map_encoder(df, fn, out, year=year if shape["use_year"] else None, payload=weights, **cols)


def embed_ring(df: DataFrame, weights: Weights, id_col: str, k: int, radius_deg: float = 0.1, *, out: str = "vec", **kw) -> DataFrame:
    """Mean embedding of a point and ``k`` ring members."""
    ring = geo.ring_points(df, k, radius_deg)
    vecs = embed(ring, weights, out="__v", **kw)
    return df.join(vector_mean(vecs, [id_col], "__v", out).drop("n"), id_col)


def embed_heads(df: DataFrame, weights: Weights, heads: dict[str, tuple[np.ndarray, np.ndarray]], *, out: str = "vec", **kw) -> DataFrame:
    """Network head output followed by every linear head of the pooled features, concatenated."""
    base = embed(embed(df, weights, dim=None, out="__p", **kw), weights, dim=None, feature="head", out="__h", **kw)
    base = base.withColumn("__p", F.col("__p").cast("array<double>"))
    w, c = np.vstack([h[0] for h in heads.values()]), np.concatenate([h[1] for h in heads.values()])
    return apply_linear(base, "__p", "__r", w, c).withColumn(
        out, F.concat(F.col("__h").cast("array<double>"), "__r")).drop("__p", "__h", "__r")


def concat_standardized(df: DataFrame, sources: Sequence[str], out: str = "vec") -> DataFrame:
    """Standardize each source over the table, then concatenate."""
    for i, s in enumerate(sources):
        df = standardized(df, s, f"__z{i}", rule="dataset")
    return df.withColumn(out, F.concat(*[f"__z{i}" for i in range(len(sources))])).drop(*[f"__z{i}" for i in range(len(sources))])


class EncoderRegistry:
    """Named encoders, each a function DataFrame -> DataFrame that adds ``vec``."""

    def __init__(self):
        self._fns: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.register("raw_coords", lambda df: df.withColumn("vec", geo.raw_features("lat", "lon")))
        self.register("xyz_coords", lambda df: df.withColumn("vec", geo.unit_xyz("lat", "lon")))
        self.register("harmonics", lambda df: df.withColumn("vec", geo.spherical_harmonics(8)("lat", "lon")))

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self._fns[name] = fn

    def register_function(self, name: str, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """``fn(lat, lon) -> [n, d]`` on NumPy batches."""
        self.register(name, lambda df: map_encoder(df, lambda _, la, lo: fn(la, lo), "vec").withColumn(
            "vec", F.col("vec").cast("array<double>")))

    def names(self) -> list[str]:
        return list(self._fns)

    def encode(self, df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
        unknown = sorted(set(names) - set(self._fns))
        if unknown:
            raise ValueError(f"unknown encoders {unknown}")
        return {n: self._fns[n](df) for n in names}

    @staticmethod
    def prefixes(tag: str, vec: str, widths: Sequence[int]) -> dict[str, object]:
        """Column expressions ``tag_w`` of one embedding's prefixes."""
        return {f"{tag}_{w}": V.prefix(vec, w) for w in widths}


def embed_cached(df: DataFrame, path: str, tag: str, digest: str, encode: Callable[[DataFrame], DataFrame], *,
                 lat: str = "lat", lon: str = "lon", force: bool = False) -> DataFrame:
    """Vectors of the table's coordinates, computing only those the cache lacks.

    The cache is a parquet table partitioned by (tag, digest), where the digest names the encoder's
    code and weights. Coordinates that it lacks are appended. Adds ``vec``, null where a coordinate is null.
    """
    spark = df.sparkSession
    slot = f"{path}/tag={tag}/digest={digest}"
    coords = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    schema = "lat double, lon double, vec array<double>"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(slot)
    exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    if exists and not force:
        todo = coords.join(spark.read.schema(schema).parquet(slot), ["lat", "lon"], "left_anti")
    else:
        todo = coords
    new = encode(todo).select("lat", "lon", F.col("vec").cast("array<double>").alias("vec"))
    new.write.mode("overwrite" if force else "append").parquet(slot)
    held = spark.read.schema(schema).parquet(slot)
    return df.join(held.select(F.col("lat").alias("__la"), F.col("lon").alias("__lo"), "vec"),
                   (F.col(lat).cast("double") == F.col("__la")) & (F.col(lon).cast("double") == F.col("__lo")), "left").drop("__la", "__lo")
