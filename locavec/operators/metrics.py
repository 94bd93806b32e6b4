"""Scores, distance bins, interpolation and cell aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geo
from ..session import cut_lineage
from .stats import percentiles

# Distance bin edges in km and the rows below which a bin has no skill.
BIN_EDGES_KM = (0.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, math.inf)
MIN_BIN_ROWS = 30
WEIGHT_FLOOR_KM = 0.01
MISSING = float("nan")


def r2_by(df: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred", floor: float | None = 1e-12) -> DataFrame:
    """R^2 per group; without a floor a constant target gives NaN."""
    res = F.sum((F.col(truth) - F.col(pred)) * (F.col(truth) - F.col(pred)))
    tot = F.var_pop(truth) * F.count(truth)
    score = 1 - res / F.greatest(tot, F.lit(floor or 1e-12))
    if floor is None:
        score = F.when(tot > 0, score).otherwise(F.lit(MISSING))
    return df.groupBy(*keys).agg(score.alias("score"), F.count(F.lit(1)).alias("n"))


def r2_columns(df: DataFrame, keys: Sequence[str], ks: Sequence[int], truth: str = "truth") -> DataFrame:
    """(*keys, k, score): ``r2_by`` without a floor for the predictions in the columns p_<k>, in one pass and without a copy of a row."""
    res = lambda k: F.sum((F.col(truth) - F.col(f"p_{k}")) * (F.col(truth) - F.col(f"p_{k}")))
    sums = df.groupBy(*keys).agg((F.var_pop(truth) * F.count(truth)).alias("tot"), *[res(k).alias(f"p_{k}") for k in ks])
    score = lambda k: F.when(F.col("tot") > 0, 1 - F.col(f"p_{k}") / F.greatest("tot", F.lit(1e-12))).otherwise(F.lit(MISSING))
    each = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), score(k).alias("score")) for k in ks])).alias("s")
    return sums.select(*keys, each).select(*keys, "s.k", "s.score")


def accuracy_by(df: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("score"), F.count(F.lit(1)).alias("n"))


def distance_bin(km: Column | str) -> Column:
    """Bin number of a distance, half-open [lo, hi)."""
    c = F.col(km) if isinstance(km, str) else km
    out = F.when(c < BIN_EDGES_KM[1], 0)
    for i in range(1, len(BIN_EDGES_KM) - 1):
        out = out.when(c < BIN_EDGES_KM[i + 1], i) if BIN_EDGES_KM[i + 1] != math.inf else out.when(c.isNotNull(), i)
    return out


def binned_skill(df: DataFrame, keys: Sequence[str] = (), *, km: str = "km", truth: str = "truth", pred: str = "pred",
                 task_type: str = "regression") -> DataFrame:
    """Skill of every distance bin: 1 - MSE / variance of all held-out targets, or 1 - error rate.

    The variance needs every row of a key, so it is carried as additive sums through the bins.
    """
    t = F.col(truth)
    err = (t - F.col(pred)) * (t - F.col(pred)) if task_type == "regression" else (t != F.col(pred)).cast("double")
    ok = F.col(km).isNotNull() & ~F.isnan(km) & err.isNotNull() & ~F.isnan(err)
    bins = df.withColumn("bin", F.when(ok, distance_bin(km)).otherwise(F.lit(-1))).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(err).alias("sse"), F.count(t).alias("tn"), F.avg(t).alias("tm"), F.var_pop(t).alias("tv"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most ten rows per key
    mean = F.sum(F.col("tm") * F.col("tn")).over(w) / F.sum("tn").over(w)
    bins = bins.withColumn("__m", mean)
    var = F.sum(F.col("tn") * (F.col("tv") + (F.col("tm") - F.col("__m")) * (F.col("tm") - F.col("__m")))).over(w) / F.sum("tn").over(w)
    denom = var if task_type == "regression" else F.lit(1.0)
    # every bin of a key is reported, those without rows with n = 0; a key has ten entries at most
    per = bins.withColumn("__d", denom).groupBy(*keys).agg(
        F.max("__d").alias("__d"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "sse")))).alias("__b")).where("__d > 0")
    per = per.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(BIN_EDGES_KM) - 2))))
    at = F.try_element_at("__b", "bin")
    scored = per.select("*", F.coalesce(at["n"], F.lit(0).cast("long")).alias("n"), at["sse"].alias("sse"))
    edges = F.array(*[F.lit(float(e)) for e in BIN_EDGES_KM])
    return scored.select(
        *keys, "bin", F.get(edges, F.col("bin")).alias("lo_km"),
        F.when(F.col("bin") < len(BIN_EDGES_KM) - 2, F.get(edges, F.col("bin") + 1)).alias("hi_km"),
        "n", F.when(F.col("n") >= MIN_BIN_ROWS, 1 - F.col("sse") / F.col("n") / F.col("__d")).alias("skill"))


def first_crossing(bins: DataFrame, narrow: str, wide: str, keys: Sequence[str] = (), encoder: str = "encoder") -> DataFrame:
    """First distance bin where the narrow encoder's skill exceeds the wide one's."""
    side = lambda name, a: bins.where(F.col(encoder) == name).select(*keys, "bin", "lo_km", "hi_km", F.col("skill").alias(a))
    both = side(narrow, "ns").join(side(wide, "ws").drop("lo_km", "hi_km"), [*keys, "bin"])
    won = both.where(F.col("ns") > F.col("ws"))
    best = won.groupBy(*keys).agg(F.min_by(F.struct("bin", "lo_km", "hi_km"), "bin").alias("b"))
    return best.select(*keys, "b.bin", "b.lo_km", "b.hi_km")


def fold_median_km(distances: DataFrame, id_col: str = "id", fold: str = "fold") -> DataFrame:
    """Mean over folds of the median nearest distance (one row)."""
    distances = cut_lineage(distances.select(id_col, fold, "km"), "km")  # ranking reads it several times
    med = percentiles(distances, "km", id_col, [0.5], group=[fold])
    return med.agg(F.avg("value").alias("median_nn_km"), F.count(F.lit(1)).alias("n_folds"))


def idw(neighbours: DataFrame, ks: Sequence[int], value: str, task_type: str = "regression") -> DataFrame:
    """Inverse-distance prediction (qid, k, pred) for several k from one neighbour list."""
    n = neighbours.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).where(F.col("rank") <= F.col("k"))
    n = n.withColumn("w", 1.0 / F.greatest(F.col("km"), F.lit(WEIGHT_FLOOR_KM)))
    if task_type == "regression":
        return n.groupBy("qid", "k").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("pred"))
    votes = n.groupBy("qid", "k", value).agg(F.sum("w").alias("v"))
    # equal votes go to the lowest class
    return votes.groupBy("qid", "k").agg(F.max_by(value, F.struct(F.col("v"), -F.col(value))).alias("pred"))


def idw_of(k: int, value: str) -> Column:
    """Prediction from the first ``k`` entries of the list ``near`` (km, value)."""
    few = F.slice("near", 1, k)
    w = lambda x: 1.0 / F.greatest(x["km"], F.lit(WEIGHT_FLOOR_KM))
    return F.aggregate(few, F.lit(0.0), lambda s, x: s + w(x) * x[value]) / F.aggregate(few, F.lit(0.0), lambda s, x: s + w(x))


def idw_lists(rows: DataFrame, ks: Sequence[int], value: str) -> DataFrame:
    """``rows`` with k and pred instead of their lists ``near`` (km, value): ``idw`` of a number without a shuffle."""
    rest = [c for c in rows.columns if c != "near"]
    preds = F.array(*[F.struct(F.lit(int(k)).alias("k"), idw_of(k, value).alias("pred")) for k in ks])
    return rows.select(*rest, F.explode(preds).alias("p")).select(*rest, "p.k", "p.pred")


# --------------------------------------------------------------------------- variogram

def prefix_distances(pairs: DataFrame, widths: Sequence[int], a: str = "va", b: str = "vb") -> DataFrame:
    """Per row and width: the columns but the vectors, width, squared distance d2 of the prefixes and norm na of the first one.

    One running sum over a batch serves all widths. Both values are null where a prefix holds nulls or is null, d2 also where lengths differ.
    """
    rest = [f for f in pairs.schema.fields if f.name not in (a, b)]
    ends = [w - 1 for w in widths]

    def sums(m: np.ndarray) -> np.ndarray:  # from left to right, as in a loop
        c = np.cumsum(m, axis=1)
        return c[:, [min(e, m.shape[1] - 1) for e in ends]] if m.shape[1] else np.zeros((len(m), len(ends)))

    def run_of(z):  # the built-in sum() compensates
        return float(np.cumsum([0.0, *z])[-1])

    def one(x, y):
        out = []
        for w in widths:
            u, v = None if x is None else x[:w], None if y is None else y[:w]
            known = u is not None and None not in u
            same = known and v is not None and None not in v and len(u) == len(v)
            out.append((run_of((i - j) * (i - j) for i, j in zip(u, v)) if same else None, math.sqrt(run_of(i * i for i in u)) if known else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(widths)
            x, y = batch.column(batch.schema.get_field_index(a)), batch.column(batch.schema.get_field_index(b))
            fx, fy = x.flatten(), y.flatten()
            long = set(np.diff(x.offsets.to_numpy()).tolist()) | set(np.diff(y.offsets.to_numpy()).tolist())
            if len(long) == 1 and not (x.null_count or y.null_count or fx.null_count or fy.null_count):
                u, v = (f.to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1) for f in (fx, fy))
                d2, na = pa.array(sums((u - v) ** 2).ravel()), pa.array(np.sqrt(sums(u * u)).ravel())
            else:
                d2, na = (pa.array(c, pa.float64()) for c in zip(*[r for i, j in zip(x.to_pylist(), y.to_pylist()) for r in one(i, j)])) if n else (
                    pa.array([], pa.float64()),) * 2
            at = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)).take(at) for f in rest],
                                              pa.array(np.tile(np.array(widths, "i4"), n), pa.int32()), d2, na], [*[f.name for f in rest], "width", "d2", "na"])

    return pairs.mapInArrow(run, T.StructType([*rest, T.StructField("width", T.IntegerType()), T.StructField("d2", T.DoubleType()),
                                               T.StructField("na", T.DoubleType())]))


def semivariance(pairs: DataFrame, widths: Sequence[int], a: str = "va", b: str = "vb", lag: str = "lag_km") -> DataFrame:
    """Half the mean squared prefix distance by lag and width, with the mean relative change."""
    long = prefix_distances(pairs.select(lag, a, b), widths, a, b)
    return long.groupBy(lag, "width").agg(
        (0.5 * F.avg("d2")).alias("gamma"),
        F.avg(F.sqrt("d2") / F.greatest(F.col("na"), F.lit(1e-9))).alias("rel_change"), F.count(F.lit(1)).alias("n_pairs"))


def half_sill(curve: DataFrame, keys: Sequence[str] = ("width",), lag: str = "lag_km", fractions=(0.45, 0.5, 0.55)) -> DataFrame:
    """Sill (median over the top quarter of lags) and the log-interpolated lag reaching a share of it.

    A curve has a few dozen lags, gathered into one sorted array per key.
    """
    c = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(lag).alias("h"), F.col("gamma").alias("g")))).alias("c"))
    n = F.size("c")
    start = F.greatest(F.lit(1), F.floor(n * 0.75).cast("int"))
    tail = F.sort_array(F.transform(F.slice("c", start + 1, n - start), lambda p: p["g"]))
    m = F.size("t")
    c = c.withColumn("t", tail).withColumn("sill", (F.get("t", ((m - 1) / 2).cast("int")) + F.get("t", (m / 2).cast("int"))) / 2)

    def reach(frac):
        goal = F.col("sill") * frac
        i = F.array_position(F.transform("c", lambda p: p["g"] >= goal), True).cast("int") - 1  # -1 when never reached
        hi, lo = F.get("c", i), F.get("c", i - 1)
        share = (goal - lo["g"]) / (hi["g"] - lo["g"])
        between = F.exp(F.log(lo["h"]) + share * (F.log(hi["h"]) - F.log(lo["h"])))
        return (
            F.when(i < 0, F.get("c", n - 1)["h"]).when(i == 0, F.get("c", F.lit(0))["h"])
            .when(hi["g"] == lo["g"], hi["h"]).otherwise(between))

    names = {0.45: "half_sill_lo_km", 0.5: "half_sill_km", 0.55: "half_sill_hi_km"}
    return c.select(*keys, "sill", *[reach(f).alias(names.get(f, f"reach_{f:g}")) for f in fractions])


# --------------------------------------------------------------------------- cells

def coarsen_mask(cells: DataFrame, level: int, row: str = "row", col: str = "col", valid: str = "valid",
                 lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cells merged 2^level by 2^level: set when any child is set, centre = mean of child centres."""
    f = 1 << level
    return cells.groupBy(F.floor(F.col(row) / f).cast("long").alias("row"), F.floor(F.col(col) / f).cast("long").alias("col")).agg(
        F.bool_or(valid).alias("land"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def cell_overview(df: DataFrame, vec: str, cell_deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Count and mean vector per grid cell."""
    a, b = geo.grid_cell(lat, lon, cell_deg)
    s = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(vec)))
    return df.groupBy(a.alias("cell_lat"), b.alias("cell_lon")).agg(s.alias("s")).select(
        "cell_lat", "cell_lon", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"))


def storage_rollup(shards: DataFrame) -> DataFrame:
    """Per level and band: bytes, cumulative bytes of the leading bands, shards present and in total."""
    per = shards.groupBy("level", "band").agg(
        F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 0).alias("present"), F.count(F.lit(1)).alias("shards"))
    w = Window.partitionBy("level").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("leading_bytes", F.sum("bytes").over(w))
