import numpy as np
import pytest
from pyspark.sql import functions as F

from locavec.operators import neighbours as NB


def _xyz(p):
    la, lo = np.radians(p.lat.to_numpy()), np.radians(p.lon.to_numpy())
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)


def _brute(p, k):
    """Row-wise neighbours of the other folds by (distance, id)."""
    p = p.sort_values("id")
    x, f, ids = _xyz(p), p.fold.to_numpy(), p.id.to_numpy()
    out = {}
    for i in range(len(p)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = np.flatnonzero(f != f[i])
        order = ok[np.lexsort((ids[ok], np.round(d[ok], 15)))][:k]
        out[ids[i]] = (ids[order].tolist(), 2 * 6371 * np.arcsin(np.clip(d[order] / 2, 0, 1)))
    return out


def _check(spark, pdf, k, **kw):
    df = spark.createDataFrame(pdf)
    got = NB.sphere_knn(df, k=k, **kw).toPandas().sort_values(["qid", "rank"])
    want = _brute(pdf, k)
    assert got.groupby("qid").size().to_dict() == {q: len(t) for q, (t, _) in want.items() if t}
    for q, part in got.groupby("qid"):
        assert np.allclose(part.km, want[q][1], atol=1e-6), q
        # ids agree except where two distances are equal to the last bit
        if len(set(np.round(part.km, 7))) == len(part):
            assert part.tid.tolist() == want[q][0], q


def _sphere(n, seed, hot=0):
    import pandas as pd

    rng = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[:hot], lon[:hot] = 48.2, 16.4
    return pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon, "fold": rng.integers(0, 5, n)})


def test_random_points_small_leaves(spark):
    _check(spark, _sphere(400, 0), 7, leaf_rows=16)


def test_a_third_of_all_rows_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(NB, "UNIT_ROWS", 20)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 30)
    _check(spark, _sphere(300, 1, hot=100), 4, leaf_rows=16)


def test_dense_cluster_is_divided_into_units(spark, monkeypatch):
    monkeypatch.setattr(NB, "UNIT_ROWS", 25)
    monkeypatch.setattr(NB, "MAX_LEAVES", 4)
    p = _sphere(300, 2)
    p.loc[:150, "lat"] = 10 + p.loc[:150, "lat"] * 1e-4
    p.loc[:150, "lon"] = 20 + p.loc[:150, "lon"] * 1e-4
    _check(spark, p, 5, leaf_rows=8)


def test_poles_and_antimeridian(spark):
    import pandas as pd

    rows = [(90.0, 0.0), (90.0, 120.0), (-90.0, 5.0), (89.9, -170.0), (0.0, 180.0), (0.0, -180.0), (0.1, 179.9), (0.05, -179.95), (-89.9, 90.0), (0.0, 0.0)]
    p = pd.DataFrame(rows, columns=["lat", "lon"])
    p["id"], p["fold"] = np.arange(len(p)), np.arange(len(p)) % 2
    _check(spark, p, 2, leaf_rows=2)


def test_k_larger_than_the_training_set(spark):
    _check(spark, _sphere(12, 3), 50, leaf_rows=4)


def test_whole_regions_in_one_fold(spark):
    p = _sphere(400, 4)
    p["fold"] = (np.floor(p.lat / 30).astype(int) + 3) % 3
    _check(spark, p, 3, leaf_rows=16)


def test_single_fold_has_no_training_rows(spark):
    p = _sphere(20, 5)
    p["fold"] = 0
    df = spark.createDataFrame(p)
    assert NB.sphere_knn(df, k=3).count() == 0
    assert NB.nearest_train_km(df).where("km is not null").count() == 0


def test_buffers_drop_strictly_closer_rows_only(spark):
    import pandas as pd

    p = _sphere(200, 6)
    df = spark.createDataFrame(p)
    radius = 900.0
    got = NB.held_out_km(df, 5, radius, leaf_rows=16).toPandas()
    x, f = _xyz(p), p.fold.to_numpy()
    km = 2 * 6371 * np.arcsin(np.clip(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) / 2, 0, 1))
    assert len(got) == sum((f != t).sum() for t in np.unique(f))
    for r in got.itertuples():
        d = km[r.id][f == r.fold].min()
        assert (np.isnan(r.km) and d >= radius - 1e-6) or abs(r.km - d) < 1e-6
    flags = NB.buffer_flags(spark.createDataFrame(pd.DataFrame({"id": [1, 2], "fold": [0, 0], "km": [0.0, 10.0]})), (0.0, 10.0)).toPandas()
    kept = {(r.id, r.radius_km): r.kept for r in flags.itertuples()}
    assert kept == {(1, 0.0): True, (1, 10.0): False, (2, 0.0): True, (2, 10.0): True}


@pytest.mark.parametrize("residual", [False, True])
def test_feature_space(spark, residual):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(150, 20)) * np.linspace(3, 0.1, 20)
    v[:50] = v[0]  # identical vectors
    ix = np.hstack([v[:, :4], np.sqrt((v[:, 4:] ** 2).sum(1))[:, None]]) if residual else v
    grp = rng.integers(0, 3, 150)
    rows = [(i, int(grp[i]), v[i].tolist(), ix[i].tolist()) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, grp long, vec array<double>, ix array<double>")
    got = NB.nearest(d.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "tid"), k=6, mode="other", residual=residual, leaf_rows=8).toPandas()
    for q, part in got.groupby("qid"):
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        ok = np.flatnonzero(grp != grp[q])
        best = ok[np.lexsort((ok, dist[ok]))][:6]
        assert np.allclose(part.sort_values("rank").dist, dist[best], atol=1e-9)
        assert part.sort_values("rank").tid.tolist() == best.tolist() or len(set(np.round(dist[best], 9))) < 6


def test_anchors_on_a_small_mask_are_all_found(spark):
    from locavec.functions import geo  # noqa: F401
    from locavec.operators import folds

    mask = spark.createDataFrame([(1, "POLYGON")], "id long, kind string").limit(0)
    with pytest.raises(ValueError):
        folds.land_anchors(spark.range(5), "id", mask)


def test_uniformity_beyond_one_block(spark):
    from locavec.operators import stats

    x = np.random.default_rng(3).normal(size=(700, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d2 = ((u[:, None] - u[None]) ** 2).sum(2)
    want = np.log(np.exp(-2 * d2[np.triu_indices(700, 1)]).mean())
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    assert abs(stats.uniformity(df, "v", "id", block_rows=64).first()[0] - want) < 1e-9


@pytest.mark.parametrize("first, hot", [(1, 0), (4, 2500)])
def test_large_leaves_are_split_by_place(spark, monkeypatch, first, hot):
    """First-level cells far above a unit, with and without one place that holds half of the rows in many groups."""
    monkeypatch.setattr(NB, "MAX_LEAVES", first)
    monkeypatch.setattr(NB, "UNIT_ROWS", 64)
    g = np.random.default_rng(first)
    x = np.concatenate([g.normal(size=(2500, 3)) * 0.01, np.zeros((hot, 3)) + 0.5])
    grp = np.concatenate([np.arange(2500) % 3, np.arange(hot)])
    t = spark.createDataFrame([(i, v.tolist(), v.tolist(), int(a)) for i, (v, a) in enumerate(zip(x, grp))], "tid long, vec array<double>, ix array<double>, grp long")
    index, _ = NB._build_index(t, 32, False)
    size, wide = index.counts.sum(axis=1), (index.hi - index.lo).max(axis=1) > 0
    assert size.sum() == len(x) and (size[wide] <= 64).all() and len(size) > 40
    assert (index.subs[wide & (size > 0)] == 1).all() and index.subs.max() == max(1, -(-hot // 64))
    assert (np.bincount(index.locate(x), minlength=len(size)) == size).all()
    q = spark.createDataFrame([(i, x[i].tolist(), x[i].tolist(), 0) for i in range(0, 2500, 25)], "qid long, vec array<double>, ix array<double>, grp long")
    got = {(r["qid"], r["rank"]): r["tid"] for r in NB.nearest(q, t, k=5, leaf_rows=32).collect()}
    for i in range(0, 2500, 25):
        d = ((x - x[i]) ** 2).sum(1)
        assert [got[i, r] for r in range(1, 6)] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_routing_of_a_block_equals_a_loop_over_its_queries():
    g = np.random.default_rng(0)
    lo = g.uniform(0, 1, (300, 3))
    index = NB.LeafIndex(*[np.zeros(1)] * 5, lo, lo + g.uniform(0, 0.1, (300, 3)), np.arange(2), g.integers(0, 9, (300, 2)), g.integers(1, 4, 300), False)
    x, group, bound = g.uniform(0, 1, (90, 3)), g.integers(0, 2, 90), g.uniform(0, 0.4, 90)
    bound[::7] = np.inf
    starts = np.concatenate([[0], np.cumsum(index.subs)])
    filled = bound.copy()
    units, n = NB._onward(index, x, group, filled, 5, 3, "other")
    at = 0
    for i in range(90):
        can = index.counts[:, 1 - group[i]]
        far = np.sqrt((np.maximum(abs(x[i] - index.lo), abs(index.hi - x[i])) ** 2).sum(1))
        if np.isinf(bound[i]):
            order = np.argsort(far)
            bound[i] = far[order[np.flatnonzero(np.cumsum(can[order]) >= 3)[0]]]
        gap = np.sqrt((np.maximum(0, np.maximum(index.lo - x[i], x[i] - index.hi)) ** 2).sum(1))
        want = [u for leaf in np.flatnonzero((gap <= bound[i] * (1 + 1e-12)) & (can > 0)) for u in range(starts[leaf], starts[leaf + 1]) if u != 5]
        assert units[at:at + n[i]].tolist() == want and filled[i] == pytest.approx(bound[i])
        at += n[i]


def _vectors(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 24))
    x[n // 2:n // 2 + 20] = x[0]  # more equal rows than neighbours asked for
    rows = [(i, x[i].tolist(), x[i, :6].tolist() + [float(np.sqrt((x[i, 6:] ** 2).sum()))], i % 3) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, ix array<double>, grp long")


@pytest.mark.parametrize("mode", [None, "other", "same"])
def test_queries_that_boxes_do_not_help_are_not_copied_to_every_unit(spark, monkeypatch, mode):
    n, k, sent = 1500, 5, []
    monkeypatch.setattr(NB, "SWEEP_QUERIES", 200)
    monkeypatch.setattr(NB, "SWEEP_ROWS", 400)
    monkeypatch.setattr(NB, "TILE_ROWS", 64)
    visit = NB._co_visit
    monkeypatch.setattr(NB, "_co_visit", lambda q, *a: sent.append(q.count()) or visit(q, *a))
    x, d = _vectors(spark, n, 4)
    got = NB.nearest(d.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "tid"), k=k, mode=mode, residual=True, leaf_rows=32)
    got = got.toPandas().sort_values(["qid", "rank"])
    assert sent[0] == n and sent[1] <= NB.SHORT * n  # before: every query went to nearly each of the 47 units
    g = np.arange(n) % 3
    for q in range(0, n, 7):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        can = np.flatnonzero(np.ones(n, bool) if mode is None else (g != g[q]) if mode == "other" else (g == g[q]))
        want = can[np.lexsort((can, np.round(dist[can], 12)))][:k]
        part = got[got.qid == q]
        assert part.tid.tolist() == want.tolist() and np.allclose(part.dist, dist[want], atol=1e-12)


def test_a_visit_holds_small_matrices():
    import tracemalloc

    g = np.random.default_rng(6)
    x, group = g.normal(size=(4096, 3)), g.integers(0, 5, 4096)
    NB._top(x[:9], group[:9], x, group, 5, "other")
    tracemalloc.start()
    NB._top(x, group, x, group, 5, "other")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # with matrices of two million cells: above 50 MB


def test_lists_equal_the_ranked_rows_and_serve_the_ladder(spark, monkeypatch):
    """Queries that one visit serves and others, ties included; the ladder goes without ranked rows, which are all shuffled."""
    from locavec.operators import metrics
    from locavec.plans import sweeps

    rng = np.random.default_rng(5)
    lat, lon = rng.integers(-40, 40, 400) / 2, rng.integers(-40, 40, 400) / 2
    rows = [(i, float(lat[i]), float(lon[i]), float(rng.normal()), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, y double, fold int")
    want = {}
    for r in NB.sphere_knn(df, k=6, payload=("y",), leaf_rows=32).collect():
        want.setdefault(r["qid"], {})[r["rank"]] = (r["km"], r["y"])
    lists = NB.sphere_lists(df, k=6, payload=("y",), leaf_rows=32)
    got = {r["id"]: {j + 1: tuple(x) for j, x in enumerate(r["near"])} for r in lists.collect()}
    assert got == want and len(got) == 400
    pred = {(r["qid"], r["k"]): r["pred"] for r in metrics.idw(NB.sphere_knn(df, k=6, payload=("y",), leaf_rows=32), [1, 6], "y").collect()}
    mine = {(r["id"], r["k"]): r["pred"] for r in metrics.idw_lists(lists, [1, 6], "y").collect()}
    assert mine.keys() == pred.keys() and all(abs(mine[x] - pred[x]) < 1e-9 for x in pred)
    monkeypatch.setattr(NB, "sphere_knn", lambda *a, **k: 1 / 0)
    out = sweeps.interpolation_sweep(df.drop("fold"), "y", benchmark="b", ks=(1, 5), cells=(0.0, 10.0))
    assert out.count() == 4
