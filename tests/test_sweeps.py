"""Sweeps on tables with invalid rows, large buffers and sparse distance bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locavec.functions import encoders
from locavec.operators import folds, models
from locavec.plans import sweeps
from locavec.session import shared_dir


@pytest.fixture(scope="module")
def points(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(240, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.1 * g.normal(size=240)
    rows = [(i, float(a), float(b), [float(t) for t in v], float(u), float(2 * u)) for i, (a, b, v, u) in
            enumerate(zip(g.uniform(-60, 60, 240), g.uniform(-170, 170, 240), x, y))]
    return spark.createDataFrame(rows, "id long, lat double, lon double, v array<double>, y double, z double")


def _spoilt(d):
    """A bad label in some rows and a bad vector in another."""
    y = F.when(F.col("id") == 7, float("nan")).when(F.col("id") == 11, None).when(F.col("id") == 13, float("inf")).otherwise(F.col("y"))
    v = F.when(F.col("id") == 17, F.array(*[F.lit(float("nan"))] * 4)).otherwise(F.col("v"))
    return d.withColumns({"y": y, "v": v})


def test_invalid_rows_do_not_change_the_scores_of_the_others(points):
    d = sweeps.with_folds(_spoilt(points), 0.0)
    assert sorted(map(sorted, models.target_groups(d, "v", ["y", "z"]))) == [[0], [1]]
    assert models.target_groups(d, "v", ["z", "lat", "lon"]) == [[0, 1, 2]]
    _, means, _ = models.nested_score(d, "v", targets=["y", "z"], alphas=(0.1, 1.0))
    got = {r["target"]: r["score"] for r in means.collect()}
    clean = d.where("id NOT IN (7, 11, 13, 17)")
    want = {t: models.nested_score(c, "v", targets=[n], alphas=(0.1, 1.0))[1].first()["score"]
            for t, n, c in ((0, "y", clean), (1, "z", d.where("id != 17")))}
    assert got.keys() == {0, 1} and all(abs(got[t] - want[t]) < 1e-9 for t in want) and got[0] > 0.9


def test_vectors_of_unequal_length_raise(spark, points):
    d = sweeps.with_folds(points.withColumn("v", F.when(F.col("id") == 3, F.slice("v", 1, 2)).otherwise(F.col("v"))), 0.0)
    with pytest.raises(Exception):
        models.nested_score(d, "v", targets=["y"], alphas=(1.0,))[1].collect()


def test_every_radius_has_a_row_and_empty_folds_count(points):
    out = sweeps.buffered_sweep(_spoilt(points), "v", ["y"], benchmark="b", radii=(0.0, 400.0, 30000.0), profiles=[models.Profile("ridge_w4", 4)],
                                alphas=(0.1, 1.0), idw_k=3).collect()
    got = {(r["mode"], r["radius_km"], r["config"]): r for r in out}
    assert len(out) == 2 * (3 + 2) and all(r["n"] == 240 and r["n_valid"] == 236 and r["n_folds"] == 5 for r in out)
    assert {r["encoder"] for r in out} == {"emb", "coord_idw"}
    full, gone = got["buffer", 0.0, "ridge_w4"], got["buffer", 30000.0, "ridge_w4"]
    assert full["frac_kept"] == 1.0 and full["score"] > 0.9
    assert gone["n_train_kept"] == 0 and gone["frac_kept"] == 0.0 and gone["score"] is None and gone["median_nn_km"] is None
    assert got["random_drop", 400.0, "ridge_w4"]["n_train_kept"] == got["buffer", 400.0, "ridge_w4"]["n_train_kept"]


def test_distance_errors_report_every_bin_over_valid_rows(points):
    out = sweeps.distance_error_sweep(_spoilt(points), {"emb": "v"}, "y", cells=(0.0,), alphas=(1.0,)).collect()
    assert [r["bin"] for r in sorted(out, key=lambda r: r["bin"])] == list(range(9)) and sum(r["n"] for r in out) == 236


def test_tasks_share_spatial_folds(points):
    scores = {r["task"]: r["score"] for r in sweeps.evaluate_tasks(_spoilt(points), "v", ["y", "z"], spatial=True, alphas=(1.0,)).collect()}
    assert set(scores) == {"y", "z", "MEAN"} and abs(scores["MEAN"] - (scores["y"] + scores["z"]) / 2) < 1e-12 and scores["y"] > 0.9


@pytest.mark.parametrize("order", ["hash", "lex"])
def test_rows_without_coordinates_get_a_fold(points, order):
    d = points.withColumns({"lat": F.when(F.col("id") % 10 != 0, F.col("lat")), "lon": F.when(F.col("id") == 5, float("nan")).otherwise(F.col("lon"))})
    got = folds.spatial_folds(d, cell_deg=30.0, order=order).select("id", "fold").collect()
    assert sorted(r["id"] for r in got) == list(range(240)) and all(0 <= r["fold"] < 5 for r in got)
    assert len({r["fold"] for r in got if r["id"] % 10 == 0 or r["id"] == 5}) == 1


def test_cached_vectors_keep_rows_without_coordinates(spark, points):
    path, d = shared_dir(spark, "cache"), points.withColumn("lat", F.when(F.col("id") % 10 != 0, F.col("lat"))).drop("v")
    encode = lambda c: c.withColumn("vec", F.array("lat", "lon"))
    for _ in range(2):
        got = encoders.embed_cached(d, path, "t", "1", encode).collect()
        assert len(got) == 240 and sum(r["vec"] is None for r in got) == 24


@pytest.mark.parametrize("k, radii", [(3, (0.0, 100.0, 400.0, 900.0)), (1, (100.0, 20000.0))])
def test_neighbour_ladder_equals_a_search_per_radius(points, k, radii):
    d = sweeps.with_folds(points, 0.0).select("id", "lat", "lon", "fold", "y")
    lv = sweeps.retention_levels(d, radii)
    hits, searched = sweeps.neighbour_ladder(d, lv, radii, ["y"], k, 5)
    p = d.orderBy("id").toPandas()
    level = {(r["mode"], r["target"], r["id"]): r["level"] for r in lv.collect()}
    la, lo = np.radians(p.lat.to_numpy()), np.radians(p.lon.to_numpy())
    xyz = np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    dist = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    want = set()
    for m, mode in enumerate(("buffer", "random_drop")):
        for i in range(len(p)):
            f = int(p.fold[i])
            for j in range(len(radii)):
                left = [t for t in range(len(p)) if level.get((mode, f, t), -1) > j]
                want |= {(i, (m * 5 + f) * len(radii) + j, r + 1, t) for r, t in enumerate(sorted(left, key=lambda t: (dist[i, t], t))[:k])}
    got = hits.collect()
    assert {(r["qid"]["id"], r["qid"]["outer"], r["rank"], r["tid"]) for r in got} == want and len(got) == len(want)
    assert all(r["y"] == p.y[r["tid"]] for r in got)
    assert searched[0] == len(p) and sum(searched) < 2 * len(p)
