"""Partition-independent randomness and exact ranks without a one-partition window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_key(*keys, seed: int = 0, stream: int = 0) -> Column:
    """64-bit hash of the keys; ``seed`` and ``stream`` give independent draws."""
    return F.xxhash64(*[_c(k) for k in keys], F.lit(int(seed)), F.lit(int(stream)))


def hash_uniform(*keys, seed: int = 0, stream: int = 0) -> Column:
    """Uniform draw in [0, 1) with 53 bits, a pure function of the keys."""
    bits = F.shiftrightunsigned(hash_key(*keys, seed=seed, stream=stream), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def hash_normal(*keys, seed: int = 0, stream: int = 0) -> Column:
    """Standard normal draw (Box-Muller on two hash streams)."""
    u1 = F.lit(1.0) - hash_uniform(*keys, seed=seed, stream=2 * stream + 1000)
    u2 = hash_uniform(*keys, seed=seed, stream=2 * stream + 1001)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def _bucket_count(df: DataFrame) -> int:
    return min(4096, max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ranked_in_buckets(df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """0-based rank: offset of each (group, bucket) plus the row number inside it.

    Buckets must follow the order, and each must be small enough for one window partition.
    """
    w_off = Window.partitionBy(*(list(group) or [F.lit(0)])).orderBy(*bucket)
    offsets = (
        df.groupBy(*group, *bucket)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.sum("__n").over(w_off) - F.col("__n"))
        .drop("__n")
    )
    # offsets has one row per (group, bucket); the join keys are never null inside a bucket,
    # while group values may be, hence the null-safe comparison on the groups.
    renamed = offsets.select(
        *[F.col(c).alias(f"__o_{c}") for c in [*group, *bucket]], "__off"
    )
    cond = F.lit(True)
    for c in [*group, *bucket]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    w_in = Window.partitionBy(*group, *bucket).orderBy(*order)
    ranked = df.withColumn("__rn", F.row_number().over(w_in))
    return (
        ranked.join(renamed, cond, "inner")
        .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long"))
        .drop("__off", "__rn", *[f"__o_{c}" for c in [*group, *bucket]])
    )


def hash_rank(df: DataFrame, keys: Sequence[str], *, group: Sequence[str] = (), seed: int = 0,
              stream: int = 0, out: str = "rank") -> DataFrame:
    """0-based rank in a seeded random order of ``keys`` (which must be unique per group).

    Buckets are the top bits of the hash, so no bucket can be hot and recomputation after a
    lost executor puts every row back where it was.
    """
    bits = max(1, (_bucket_count(df) - 1).bit_length())
    h = df.withColumn("__h", hash_key(*keys, seed=seed, stream=stream)).withColumn(
        "__b", F.shiftright("__h", 64 - bits)
    )
    return ranked_in_buckets(h, group, ["__b"], [F.col("__h"), *[F.col(k) for k in keys]], out).drop("__h", "__b")


def value_rank(df: DataFrame, key: str, tie: str, *, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based rank by a numeric ``key``, ties by the unique numeric ``tie`` column.

    Buckets come from quantile cut points of the key. A value that fills a bucket by itself is
    split again at quantiles of ``tie`` among its rows, so one hot value does not make a hot task.
    """
    n = _bucket_count(df)
    probs = [i / n for i in range(1, n)]
    cuts = df.stat.approxQuantile(key, probs, 0.25 / n)
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    # a heavy value v gets the bucket [v, next float after v) to itself
    b = _bucketed(df, key, sorted({*cuts, *[math.nextafter(v, math.inf) for v in heavy]}), "__b")
    if heavy:
        rows = df.where(F.col(key).isin(heavy))
        b = _bucketed(b, tie, sorted(set(rows.stat.approxQuantile(tie, probs, 0.25 / n))), "__s")
        b = b.withColumn("__s", F.when(F.col(key).isin(heavy), F.col("__s")).otherwise(F.lit(0)))
    else:
        b = b.withColumn("__s", F.lit(0))
    return ranked_in_buckets(b, group, ["__b", "__s"], [F.col(key).asc_nulls_first(), F.col(tie)], out).drop("__b", "__s")


def _bucketed(df: DataFrame, col: str, edges: Sequence[float], out: str) -> DataFrame:
    """Bucket number of ``col`` among the edges; nulls come first."""
    if not edges:
        return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    cut = Bucketizer(splits=[-math.inf, *[float(e) for e in edges], math.inf], inputCol="__x", outputCol="__y",
                     handleInvalid="keep")
    wide = cut.transform(df.withColumn("__x", F.col(col).cast("double")))
    return wide.withColumn(out, F.when(F.col(col).isNull(), F.lit(-1)).otherwise(F.col("__y").cast("int"))).drop("__x", "__y")


def prefix_sum(df: DataFrame, order: str, value: str, out: str = "cum") -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the unique numeric ``order`` column."""
    n = _bucket_count(df)
    b = _bucketed(df, order, sorted(set(df.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n))), "__b")
    off = (
        b.groupBy("__b").agg(F.sum(value).alias("__t"))
        .withColumn("__off", F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__t"))
        .select("__b", "__off")
    )
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        b.withColumn("__run", F.sum(value).over(w)).join(off, "__b")
        .withColumn(out, F.col("__off") + F.col("__run")).drop("__b", "__off", "__run")
    )


def fixed_sample(df: DataFrame, n: int, keys: Sequence[str], *, group: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniformly by hash rank, optionally per group."""
    return hash_rank(df, keys, group=group, seed=seed, stream=77, out="__rank").where(F.col("__rank") < n).drop("__rank")
