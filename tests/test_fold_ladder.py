"""Predictions under many fold assignments of the same rows, next to a loop over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locavec.functions import geo
from locavec.operators import fold_ladder as FL
from locavec.operators import metrics
from locavec.operators import neighbours as NB
from locavec.plans import sweeps

KS = (1, 4, 9)


def _places(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[:hot], lon[:hot] = 48.2, 16.4
    lat[-4:], lon[-4:] = [90.0, -90.0, 0.0, 0.0], [0.0, 50.0, 180.0, -180.0]
    p = pd.DataFrame({"id": rng.permutation(n), "lat": lat, "lon": lon, "y": rng.normal(size=n).round(6)})
    p["f0"] = rng.integers(0, 5, n)
    p["f1"] = (np.floor(lat / 60).astype(int) + 3) % 2          # wide regions: far neighbours
    p["f2"] = np.where((lat > 40) & (lat < 60) & (lon > 0) & (lon < 40), 1, 0)
    p["f3"] = 0                                                 # no row of another fold
    p["f4"] = (np.arange(n) < n - 3).astype(int)                # three rows against all others
    return p


def _brute(spark, p, grids):
    xyz = geo.unit_xyz("lat", "lon")
    t = spark.createDataFrame(p).select("*", *[xyz[j].alias(c) for j, c in enumerate("abc")]).toPandas().sort_values("id")
    x, y = t[["a", "b", "c"]].to_numpy(), t.y.to_numpy()
    out = []
    for g, name in enumerate(grids):
        f = t[name].to_numpy()
        for i in range(len(t)):
            d2 = np.zeros(len(t))
            for j in range(3):
                d2 += (x[i, j] - x[:, j]) ** 2
            d = np.sqrt(d2)
            ok = np.flatnonzero(f != f[i])
            near = ok[np.argsort(d[ok], kind="stable")]
            w = 1 / np.maximum(2 * 6371 * np.arcsin(np.minimum(1, d[near] / 2)), metrics.WEIGHT_FLOOR_KM)
            if len(near):
                out.append((g, f[i], y[i], *[(w[:k] * y[near[:k]]).sum() / w[:k].sum() for k in KS]))
    return out


def _check(spark, p, grids=("f0", "f1", "f2", "f3", "f4")):
    got = FL.idw_ladder(spark.createDataFrame(p), grids, KS, "y").collect()
    got, want = (np.array(sorted(tuple(float(v) for v in r) for r in rows)) for rows in (got, _brute(spark, p.dropna(), grids)))
    assert got.shape == want.shape
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("hot", [0, 150])
def test_predictions_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(FL, "LEAF_ROWS", 64)
    monkeypatch.setattr(FL, "CELL_ROWS", 8)
    monkeypatch.setattr(FL, "NEAREST_CELLS", 10)
    monkeypatch.setattr(NB, "UNIT_ROWS", 100)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 50)
    _check(spark, _places(600, 3, hot))


def test_leaves_that_need_many_rows_are_searched_in_general(spark, monkeypatch):
    seen = []
    general = FL._searched
    monkeypatch.setattr(FL, "_searched", lambda asked, train, c, ks: seen.append(c) or general(asked, train, c, ks))
    monkeypatch.setattr(FL, "LEAF_ROWS", 64)
    monkeypatch.setattr(FL, "CELL_ROWS", 8)
    monkeypatch.setattr(FL, "MEET_ROWS", 100)
    monkeypatch.setattr(FL, "MEET_CELLS", 1)
    _check(spark, _places(400, 4))
    assert 1 in seen and 3 not in seen


def test_many_assignments_and_ties(spark, monkeypatch):
    monkeypatch.setattr(FL, "MAX_GRIDS", 2)
    monkeypatch.setattr(FL, "LEAF_ROWS", 32)
    monkeypatch.setattr(FL, "CELL_ROWS", 4)
    p = _places(200, 5)
    p["lat"], p["lon"] = 0.0, np.arange(200) % 40 / 4.0  # mirror places on the equator
    _check(spark, p, ("f0", "f1", "f4"))


def test_rows_without_a_place_and_without_rows(spark):
    p = _places(60, 6)
    p.loc[:4, "lat"] = np.nan
    _check(spark, p, ("f0",))
    nothing = spark.createDataFrame(p).limit(0)
    assert FL.idw_ladder(nothing, ["f0"], KS, "y").count() == 0
    assert sweeps.interpolation_sweep(nothing.select("id", "lat", "lon", "y"), "y", benchmark="b", ks=(1,), cells=(0.0, 5.0)).count() == 0


def test_all_cell_sizes_share_one_search(spark, monkeypatch):
    """The ladder built an index and visited all rows once per cell size."""
    built, build = [], NB._build_index
    monkeypatch.setattr(NB, "_build_index", lambda *a: built.append(1) or build(*a))
    p = spark.createDataFrame(_places(300, 7)).select("id", "lat", "lon", "y")
    cells = (0.0, 5.0, 40.0)
    got = sweeps.interpolation_sweep(p, "y", benchmark="b", ks=(1, 5), cells=cells, order="lex")
    got = {(r["cell_deg"], r["k"]): r["score"] for r in got.collect()}
    assert len(built) == 1
    for cell in cells:
        d = sweeps.with_folds(p, cell, order="lex")
        pred = metrics.idw(NB.sphere_knn(d, k=5, payload=("y",)), (1, 5), "y")
        by = metrics.r2_by(pred.join(d.select(F.col("id").alias("qid"), "fold", F.col("y").alias("truth")), "qid"), ["fold", "k"], floor=None)
        want = {r["k"]: r["s"] for r in by.where(~F.isnan("score")).groupBy("k").agg(F.avg("score").alias("s")).collect()}
        assert {k: got[cell, k] for k in want} == pytest.approx(want, abs=1e-9)
    assert len(got) == 6


def test_a_leaf_far_inside_a_fold_needs_a_strip_of_cells():
    """A plane of 64 x 64 cells, folds are its halves: the leaf in a corner meets the border next to it, not the other half."""
    at = np.stack(np.meshgrid(np.arange(64.0), np.arange(64.0), indexing="ij"), axis=2).reshape(-1, 2)
    lo = np.column_stack([at, np.zeros(len(at))])
    side = (at[:, 0] >= 32).astype(int)
    counts = np.zeros((len(at), 1, 8), int)
    counts[np.arange(len(at)), 0, side] = 40
    cells = FL.Cells(np.arange(len(at)), np.zeros(len(at), int), lo, lo + 1, np.full(len(at), 40), FL._free(counts).reshape(len(at), -1).astype("u1"),
                     (counts > 0).reshape(len(at), -1))
    found, need = FL._needed(cells, 0, 20, 1)
    assert need.all() and set(side[found]) == {1} and at[found, 0].max() <= 34 and len(found) < 60
    d = np.sqrt(((np.maximum(at - 1, 0)) ** 2).sum(axis=1))  # smallest distances; the k-th neighbour is in a cell that ends within 33.04
    assert set(np.flatnonzero((side == 1) & (d < 31.5))) <= set(found)
