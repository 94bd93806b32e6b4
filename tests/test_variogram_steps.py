"""Prefix distances beside the column functions, and the variogram's shuffles."""

import numpy as np
from pyspark.sql import functions as F

from locavec import fixtures as X
from locavec.functions import vectors as V
from locavec.operators import metrics
from locavec.plans import sweeps

SF = "/root/testdata/sf0.001"


def test_prefix_distances_equal_the_column_functions(spark):
    rng = np.random.default_rng(2)
    rows = [(float(i), rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for i in range(50)]
    odd = [(50.0, None, [1.0]), (51.0, [1.0, None, 3.0], [1.0, 2.0, 3.0]), (52.0, [1.0, 2.0], [1.0, 2.0, 3.0]), (53.0, [], []), (54.0, [float("nan")], [1.0])]
    for part in (rows, odd, rows + odd, []):
        d = spark.createDataFrame(part, "lag_km double, va array<double>, vb array<double>").coalesce(1)
        got = {(r["lag_km"], r["width"]): (repr(r["d2"]), repr(r["na"])) for r in metrics.prefix_distances(d, (1, 3, 20)).collect()}
        want = {}
        for w in (1, 3, 20):
            x, y = V.prefix("va", w), V.prefix("vb", w)
            for r in d.select("lag_km", V.squared_distance(x, y).alias("d2"), V.norm(x).alias("na")).collect():
                want[r["lag_km"], w] = (repr(r["d2"]), repr(r["na"]))
        assert got == want


def test_no_vector_of_a_pair_is_shuffled(spark, monkeypatch):
    """Vectors of the far ends are made after the last join of the variogram."""
    plans = []
    kept = metrics.semivariance

    def seen(pairs, *a):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return kept(pairs, *a)

    monkeypatch.setattr(metrics, "semivariance", seen)
    sweeps.variogram(X.points(spark, SF).select("id", "lat", "lon"), X.demo_weights(), widths=X.WIDTHS, lags=[10.0, 100.0], pairs_per_lag=None, dim=64)
    top = plans[0]
    assert "Join" in top and top.index("MapInArrow") < top.index("Join")
    assert "vb" not in top[top.index("Join"):]


def test_a_draw_in_two_polygons_counts_once(spark):
    from locavec.operators import folds

    land = X.polygons(spark)
    p = X.points(spark, SF).select("id", "lat", "lon").withColumn("lag_km", F.lit(500.0))
    one = sorted(map(tuple, folds.land_offsets(p, "id", land, seed=6).collect()))
    twice = land.unionByName(land.withColumn("poly", F.col("poly") + 1000)) if dict(land.dtypes)["poly"] != "string" else land.unionByName(
        land.withColumn("poly", F.concat("poly", F.lit("b"))))
    assert one == sorted(map(tuple, folds.land_offsets(p, "id", twice, seed=6).collect())) and len(one) == len({r[0] for r in one})
