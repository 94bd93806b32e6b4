"""Cleaning: one canonical schema, long task tables, class codes and validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from .primitives import _c, hash_uniform

CANONICAL_COLUMNS = ("lon", "lat", "timestamp", "timestamp_end", "split", "id")
LON_NAMES = ("lon", "longitude", "Lon", "x")
LAT_NAMES = ("lat", "latitude", "Lat", "y")
LOG_LABELS = ("population", "income", "nightlights", "housing")
VALUE_NODATA = -999.0
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def to_unix_ms(col, unit: str = "ms") -> Column:
    """Milliseconds since 1970 UTC; a year means its 1 January, an unusable year gives null."""
    c = _c(col)
    if unit == "ms":
        return c.cast("bigint")
    if unit == "year":
        y = c.cast("int")
        ok = y.between(1, 9999) & (c.cast("double") == y.cast("double"))
        one = F.lit(1)
        return F.when(ok, F.unix_millis(F.make_timestamp(y, one, one, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))))
    raise ValueError(f"unknown timestamp unit {unit!r}")


def canonicalize(df: DataFrame, *, lon: str, lat: str, timestamp: str | None = None, timestamp_end: str | None = None,
                 unit: str = "ms", split: str | None = None, split_value: str | None = None, id: str | None = None,
                 drop: Sequence[str] = ()) -> DataFrame:
    """The six leading columns in fixed order and type, then every unused source column untouched."""
    if split is not None and split_value is not None:
        raise ValueError("split and split_value are mutually exclusive")
    null = lambda t: F.lit(None).cast(t)
    q = lambda name: F.col(f"`{name}`")
    head = [
        q(lon).cast("double").alias("lon"),
        q(lat).cast("double").alias("lat"),
        (to_unix_ms(q(timestamp), unit) if timestamp else null("bigint")).alias("timestamp"),
        (to_unix_ms(q(timestamp_end), unit) if timestamp_end else null("bigint")).alias("timestamp_end"),
        (q(split).cast("string") if split else F.lit(split_value).cast("string")).alias("split"),
        (q(id).cast("string") if id else null("string")).alias("id"),
    ]
    used = {lon, lat, timestamp, timestamp_end, split, id, *drop}
    return df.select(*head, *[q(c) for c in df.columns if c not in used])


def validation_counts(df: DataFrame) -> DataFrame:
    """One row of violation counts."""
    bad = lambda c, m: F.count_if(F.col(c).isNotNull() & ~F.isnan(c) & ~F.col(c).between(-m, m))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lon").isNull() | F.isnan("lon") | F.col("lat").isNull() | F.isnan("lat")).alias("null_coords"),
        bad("lon", 180.0).alias("bad_lon"), bad("lat", 90.0).alias("bad_lat"),
    )


def validate(df: DataFrame, name: str) -> None:
    """Raise with counts unless the head is complete and every coordinate is usable."""
    missing = [c for c in CANONICAL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing canonical columns {missing}")
    r = validation_counts(df).first()
    if r["null_coords"] or r["bad_lon"] or r["bad_lat"]:
        raise ValueError(f"{name}: {r['null_coords']} null, {r['bad_lon']} lon and {r['bad_lat']} lat out of range")


def clean_names(df: DataFrame, lower: bool = False) -> DataFrame:
    """Strip padding from column names, optionally lower-casing them."""
    return df.toDF(*[(c.strip().lower() if lower else c.strip()) for c in df.columns])


def first_name(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def coordinate_names(df: DataFrame, by_prefix: bool = False) -> tuple[str, str]:
    """(lon, lat) column names, from known names or by case-insensitive prefix."""
    if by_prefix:
        pick = lambda p: next((c for c in df.columns if c.strip().lower().startswith(p)), None)
        lon, lat = pick("lon"), pick("lat")
    else:
        lon, lat = first_name(df, LON_NAMES), first_name(df, LAT_NAMES)
    if lon is None or lat is None:
        raise ValueError(f"no coordinate columns among {df.columns}")
    return lon, lat


def temperature_name(df: DataFrame) -> str:
    """An explicit temperature column, else the first starting with 'mean'."""
    low = {c.lower(): c for c in df.columns}
    hit = [c for n, c in low.items() if "temp" in n or n == "meant"] or [c for n, c in low.items() if n.startswith("mean")]
    if not hit:
        raise ValueError("no temperature column")
    return hit[0]


def target_name(df: DataFrame, label: str, reserved: Sequence[str] = ("id", "lat", "lon", *CANONICAL_COLUMNS)) -> str:
    """Numeric column holding the label's name, else 'price', else the first numeric one."""
    skip = {r.lower() for r in reserved}
    cand = [f.name for f in df.schema if f.name.lower() not in skip and not f.name.startswith("Unnamed")
            and isinstance(f.dataType, NUMERIC)]
    if not cand:
        raise ValueError(f"no numeric column for {label!r}")
    return next((c for c in cand if label in c.lower()), None) or next((c for c in cand if c.lower() == "price"), cand[0])


def parse_point(col) -> tuple[Column, Column]:
    """(lon, lat) from text such as ``POINT (12.5 -3.25)``; anything else gives null."""
    pat = r"POINT \(([-0-9.]+) ([-0-9.]+)\)"
    part = lambda i: F.regexp_extract(_c(col), pat, i).try_cast("double")
    return part(1), part(2)


def melt_tasks(df: DataFrame, keep: Sequence[str], tasks: Sequence[str], *, rename: dict[str, str] | None = None,
               drop_invalid: bool = True) -> DataFrame:
    """Wide to long (keep..., task, y); a row is dropped only for the tasks it has no value for."""
    missing = [t for t in tasks if t not in df.columns]
    if missing:
        raise ValueError(f"expected task columns {missing} are missing; present: {df.columns}")
    names = rename or {}
    wide = df.select(*keep, *[F.col(t).cast("double").alias(names.get(t, t)) for t in tasks])
    long = wide.unpivot(list(keep), [names.get(t, t) for t in tasks], "task", "y")
    return long.where(F.col("y").isNotNull() & ~F.isnan("y")) if drop_invalid else long


def drop_value(df: DataFrame, col: str, sentinel) -> DataFrame:
    """Rows equal to a storage sentinel go; null rows stay."""
    return df.where(~F.col(col).eqNullSafe(F.lit(sentinel)))


def nonpositive_to_null(col) -> Column:
    return F.when(_c(col) > 0, _c(col))


def log_label(col, label: str) -> Column:
    return F.log1p(_c(col)) if label in LOG_LABELS else _c(col)


def finite(col) -> Column:
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def infer_task_type(df: DataFrame, y: str, max_classes: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """One row: classification when every label is finite and integral with few distinct values.

    Distinct labels are counted only up to the limit, from the map-side reduced distinct set.
    """
    c = F.col(y)
    few = df.select(y).distinct().limit(max_classes + 1).count()
    whole = df.agg(
        F.min(finite(y)).alias("all_finite"),
        F.max(F.abs(c - F.rint(c)) - F.lit(1e-5) * F.abs(F.rint(c))).alias("off"),
    ).withColumn("few", F.lit(few).cast("long"))
    return whole.select(
        F.when(F.col("all_finite") & (F.col("off") <= tolerance) & (F.col("few") <= max_classes), "classification")
        .otherwise("regression").alias("task_type"),
        F.least(F.col("few"), F.lit(max_classes + 1)).alias("n_classes_seen"),
    )


def year_of_ms(col) -> Column:
    return F.year(F.timestamp_millis(_c(col)))


def is_test(df: DataFrame, scheme: str | None = None) -> Column:
    """Official split flag from ``<scheme>_split`` or from the canonical split column."""
    return F.coalesce(F.col(f"{scheme}_split" if scheme else "split").cast("string") == "test", F.lit(False))


def sorted_codes(df: DataFrame, label: str, id_col: str, out: str = "code", buckets: int = 128) -> DataFrame:
    """Class codes in label order, by ranking the distinct labels; works for any number of labels.

    Cut points come from a bounded sample of the distinct labels; codes are a count per bucket plus
    a window inside it, so labels that share a long prefix still spread over the buckets.
    """
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    n, want = labels.count(), 32 * buckets
    few = labels if n <= want else labels.where(hash_uniform(label, seed=17) < want / n)
    seen = sorted(r[0] for r in few.limit(2 * want).collect())
    cuts = seen[:: max(1, len(seen) // buckets)][1:]
    cut_array = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(T.ArrayType(df.schema[label].dataType))
    labels = labels.withColumn("__b", F.size(F.filter(cut_array, lambda c: c <= F.col(label))))
    offs = labels.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn(  # one row per bucket
        "__off", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__n")).select("__b", "__off")
    w = Window.partitionBy("__b").orderBy(label)
    codes = labels.withColumn("__r", F.row_number().over(w)).join(offs, "__b").select(
        label, (F.col("__off") + F.col("__r") - 1).cast("int").alias(out))
    return df.join(codes, label, "left")


def valid_rows(label: str, features: str | None = None, numeric: bool = True) -> Column:
    """Label present (and finite when numeric), every feature finite."""
    ok = finite(label) if numeric else F.col(label).isNotNull()
    return ok & V.all_finite(features) if features else ok


def task_signatures(long: DataFrame, id_col: str = "id", task: str = "task", valid: str = "valid") -> DataFrame:
    """(task, group_key): tasks with the same set of valid rows share a key.

    The key is a count with two order-free hash sums, so no id list is ever gathered.
    """
    h = lambda s: F.sum(F.when(F.col(valid), F.xxhash64(F.col(id_col), F.lit(s)).cast("decimal(38,0)")))
    return long.groupBy(task).agg(
        F.count_if(F.col(valid)).alias("n_valid"), h(1).alias("h1"), h(2).alias("h2")
    ).select(task, "n_valid", F.concat_ws("/", F.col("n_valid"), F.col("h1"), F.col("h2")).alias("group_key"))


def fill_coordinates(df: DataFrame, siblings: Sequence[DataFrame], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(joined, unmatched): coordinates by id from sibling tables, first complete sibling row per id."""
    maps = None
    for order, s in enumerate(siblings):
        part = s.select(id_col, "lat", "lon", F.lit(order).alias("__o")).dropna()
        maps = part if maps is None else maps.unionByName(part)
    # min_by is combined before the shuffle, unlike a row_number over a hot id
    one = maps.groupBy(id_col).agg(F.min(F.struct("__o", "lat", "lon")).alias("m")).select(id_col, "m.lat", "m.lon")
    base = df.drop("lat", "lon")
    return base.join(one, id_col), base.join(one, id_col, "left_anti")


def keep_pool(df: DataFrame, pool: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(pool.select(id_col), id_col, "left_semi")


def class_size_at_least(df: DataFrame, label: str, n: int = 10) -> DataFrame:
    """Rows of classes with at least ``n`` rows. Counts are reduced map-side, then joined back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_size")).where(F.col("class_size") >= n)
    return df.join(sizes, label)


def first_per_id(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """First row per id in the given order, combined before the shuffle."""
    rest = [c for c in df.columns if c != id_col]
    keyed = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(id_col).agg(keyed).select(id_col, "r.*")
