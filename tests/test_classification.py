"""Class targets in selection and in every sweep against loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locavec.operators import models as M
from locavec.plans import sweeps

ALPHAS = (0.1, 10.0, 1000.0)
N = 240


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(8)
    x = g.normal(size=(N, 5)) * np.array([1, 2, 3, 1, 1]) + 2
    c = np.array(["wood", "crop", "sea", "town"])[np.argmax(x[:, :4] + 0.7 * g.normal(size=(N, 4)), axis=1)]
    return x, c, g.uniform(-60, 60, N), g.uniform(-170, 170, N)


@pytest.fixture(scope="module")
def table(spark, data):
    x, c, lat, lon = data
    rows = [(i, float(lat[i]), float(lon[i]), x[i].tolist(), str(c[i]), i % 4 == 1) for i in range(N)]
    d = spark.createDataFrame(rows, "id long, lat double, lon double, v array<double>, c string, test boolean")
    return d.withColumn("c", F.when(~F.col("id").isin(5, 9), F.col("c")))  # two rows without a class


def codes(c):
    return np.unique(c, return_inverse=True)[1]


def accuracy(x, y, tr, te, alpha, rule="probe", penalty=None):
    sd = x[tr].std(0, ddof=1)
    k = (1 / sd) * (1 if penalty is None else penalty**-0.5)
    z, zt = (x[tr] - x[tr].mean(0)) * k, (x[te] - x[tr].mean(0)) * k
    hot = np.eye(y.max() + 1)[y]
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (hot[tr] - hot[tr].mean(0)))
    return ((zt @ w + hot[tr].mean(0)).argmax(1) == y[te]).mean()


def nested(x, y, fold, bucket, rule="random"):
    out = []
    for f in np.unique(fold):
        inner = []
        for a in ALPHAS:
            parts = [(fold != f) & (bucket == b) for b in range(5)] if rule == "random" else [fold == g for g in np.unique(fold) if g != f]
            inner.append(np.mean([accuracy(x, y, (fold != f) & ~t, t, a) for t in parts]))
        out.append(accuracy(x, y, fold != f, fold == f, ALPHAS[int(np.argmax(np.round(inner, 12)))]))
    return np.mean(out)


def kept(table, data, cell, flag=None):
    """Rows with a class as (x, codes, fold, bucket)."""
    d = sweeps.with_folds(table, cell)
    p = d.where("c IS NOT NULL").select("id", "fold", "bucket").orderBy("id").toPandas()
    return data[0][p.id], codes(data[1][p.id]), p.fold.to_numpy(), p.bucket.to_numpy()


def test_block_sizes(table, data):
    out = sweeps.block_size_sweep(table, "v", ["c"], benchmark="b", widths=(2, 5), cells=(0.0, 30.0), alphas=ALPHAS, task_type="classification")
    got = {(r["cell_deg"], r["width"]): r for r in out.collect()}
    assert len(got) == 4 and all(r["task_type"] == "classification" and r["task"] == "c" for r in got.values())
    for (cell, w), r in got.items():
        x, y, fold, bucket = kept(table, data, cell)
        assert abs(r["score"] - nested(x[:, :w], y, fold, bucket, "spatial" if cell else "random")) < 1e-5


def test_official_split_overrides_folds(table, data):
    out = sweeps.block_size_sweep(table, "v", ["c"], benchmark="b", widths=(5,), cells=(0.0,), alphas=(1.0,), task_type="classification", test_flag="test").collect()
    keep = np.setdiff1d(np.arange(N), [5, 9])
    y, te = codes(data[1][keep]), keep % 4 == 1
    assert len(out) == 1 and abs(out[0]["score"] - accuracy(data[0][keep], y, ~te, te, 1.0)) < 1e-5


def test_penalties(table, data):
    res, ch = sweeps.penalty_sweep(table, "v", ["c"], benchmark="b", widths=(5,), starts=(2,), betas=(3.0,), powers=(), cells=(30.0,), alphas=ALPHAS,
                                   task_type="classification")
    x, y, fold, bucket = kept(table, data, 30.0)
    got = {(r["config"], r["rule"]): r["score"] for r in res.collect()}
    assert abs(got["ridge_w5", "nested"] - nested(x, y, fold, bucket)) < 1e-5
    assert abs(got["ridge_w5", "nested_spatial"] - nested(x, y, fold, bucket, "spatial")) < 1e-5
    pen = np.array([1.0, 1.0, 3.0, 3.0, 3.0])
    best = max(np.mean([accuracy(x, y, fold != f, fold == f, a, penalty=pen) for f in range(5)]) for a in ALPHAS)
    assert abs(got["tik_chunk_b3", "selected"] - best) < 1e-5 and {r["rule"] for r in ch.collect()} == {"nested", "nested_spatial"}


def test_buffers(table, data):
    radii = (0.0, 900.0)
    out = sweeps.buffered_sweep(table, "v", ["c"], benchmark="b", radii=radii, profiles=[M.Profile("ridge_w5", 5)], alphas=ALPHAS, idw_k=3,
                                task_type="classification").collect()
    got = {(r["mode"], r["radius_km"], r["config"]): r for r in out}
    assert len(got) == 3 * 2 and all(r["task_type"] == "classification" and r["n_valid"] == N - 2 for r in out)
    d = sweeps.with_folds(table.where("c IS NOT NULL"), 0.0)
    p = d.orderBy("id").toPandas()
    level = {(r["mode"], r["target"], r["id"]): r["level"] for r in sweeps.retention_levels(d, radii).collect()}
    x, y, fold, bucket = data[0][p.id], codes(data[1][p.id]), p.fold.to_numpy(), p.bucket.to_numpy()
    for (mode, radius, config), r in got.items():
        if config != "ridge_w5":
            continue
        scores = []
        for f in range(5):
            keep = np.array([level.get((mode, f, i), -1) > radii.index(radius) for i in p.id])
            inner = [np.mean([accuracy(x, y, keep & (bucket != b), keep & (bucket == b), a) for b in range(5)]) for a in ALPHAS]
            scores.append(accuracy(x, y, keep, fold == f, ALPHAS[int(np.argmax(np.round(inner, 12)))]))
        assert abs(r["score"] - np.mean(scores)) < 1e-5
    assert 0 <= got["buffer", 900.0, "idw_k3"]["score"] <= 1


def test_distances(table, data):
    out = sweeps.distance_error_sweep(table, {"emb": "v"}, "c", cells=(0.0,), alphas=(1.0,), task_type="classification").collect()
    x, y, fold, _ = kept(table, data, 0.0)
    assert sum(r["n"] for r in out) == N - 2
    total = sum(r["n"] * r["skill"] for r in out if r["skill"] is not None)
    few = sum(r["n"] for r in out if r["skill"] is None)
    right = sum(accuracy(x, y, fold != f, fold == f, 1.0) * (fold == f).sum() for f in range(5))
    assert right - few - 1e-2 <= total <= right + 1e-2


def test_scoring_in_batches_gives_the_same_grid(table, monkeypatch):
    d, n = M.class_codes(sweeps.with_folds(table.where("c IS NOT NULL"), 0.0), "c")
    read = lambda: {(r["outer"], r["inner"], r["profile"], r["alpha"]): (r["score"], r["n_test"]) for r in M.score_grid(
        d, "v", cls="cls_code", n_classes=n, profiles=M.make_profiles(5, (2, 5), (3.0,), (1.0,), (2,)), alphas=ALPHAS)[0].collect()}
    whole = read()
    monkeypatch.setattr(M, "WEIGHT_BYTES", 30 * 4 * 6 * 8)  # thirty weight sets a pass
    monkeypatch.setattr(M, "SCORED", 30)
    seen = []
    batches = M._weight_batches
    monkeypatch.setattr(M, "_weight_batches", lambda g, c: [b for b in batches(g.where("outer = 0 AND inner < 1"), c)] and seen.append(batches(g, c)) or seen[-1])
    assert read() == whole and len(whole) == 30 * 4 * 3
    assert len(seen[-1]) == 12 and max(sum(len(a) for *_, a in b) for b in seen[-1]) <= 30


def test_five_hundred_classes_on_the_full_grid(spark):
    """17 profiles and 21 penalties; the weights of a fit take 10 MB, those of the grid 300 MB."""
    g = np.random.default_rng(3)
    x = g.normal(size=(2000, 6))
    rows = [(i, x[i].tolist(), int(i % 500)) for i in range(2000)]
    d = sweeps.with_folds(spark.createDataFrame(rows, "id long, v array<double>, c int"), 0.0)
    pr = M.make_profiles(6, (1, 2, 3, 4, 5, 6, 6, 6, 6), M.CHUNK_BETAS, M.POWER_EXPONENTS, (2, 4))
    grid, _ = M.score_grid(d, "v", cls="c", n_classes=500, profiles=pr, inner="spatial")
    got = grid.groupBy("outer", "inner").agg(F.count("*").alias("n"), F.sum("n_test").alias("t")).collect()
    assert len(pr) == 17 and len(got) == 25 and all(r["n"] == 17 * 21 and r["t"] == 400 * 17 * 21 for r in got)


def test_many_labels_get_codes(spark):
    d = spark.range(25_000).select("id", F.format_string("k%05d", F.col("id")).alias("k"))
    coded, n = M.class_codes(d, "k")
    assert n == 25_000 and coded.where("cls_code != id").count() == 0


def test_a_grid_of_many_fits(spark):
    """4000 fits with weights of their own: a condition with a term for each would be too deep for the planner."""
    n = 4000
    rows = spark.range(2 * n).select((F.col("id") % n).alias("fold"), F.lit(0).alias("bucket"), F.array(F.lit(1.0)).alias("v"), (F.col("id") % 2).alias("c"))
    weight = F.when(F.col("target") == F.col("outer") % 2, 1.0).otherwise(0.0)  # the class is that of the fold
    grid = spark.range(n).select(F.col("id").alias("outer"), F.lit(-1).cast("long").alias("inner"), F.lit(0).alias("profile"), F.lit(0).alias("alpha"),
                                 F.explode(F.array(F.lit(0), F.lit(1))).alias("target")).withColumn("coef", F.array(weight, F.lit(0.0)))
    got = M.accuracy_grid(rows, "v", "c", 2, grid, ("fold", "bucket"), M.fold_tests("random")).collect()
    assert len(got) == n and all(r["score"] == 1.0 and r["n_test"] == 2 for r in got)
