import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locavec import fixtures as X
from locavec.functions import color, encoders, geo
from locavec.functions import vectors as V


def test_hilbert_curve_visits_every_cell_once_with_unit_steps(spark):
    bits, side = 4, 16
    g = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    eps = 1e-9
    g = g.withColumn("lon", F.col("x") / (side - 1) * 360 - 180 + eps).withColumn("lat", F.col("y") / (side - 1) * 180 - 90 + eps)
    d = g.select("x", "y", geo.hilbert_key("lat", "lon", bits).alias("h")).toPandas().sort_values("h")
    assert d.h.tolist() == list(range(side * side))
    step = d.x.diff().abs().iloc[1:] + d.y.diff().abs().iloc[1:]
    assert (step == 1).all()


def test_wkb_and_bbox(spark):
    r = spark.createDataFrame([(12.5, -3.25)], "lat double, lon double").select(
        geo.wkb_point("lat", "lon").alias("w"), geo.bbox_struct("lat", "lon").alias("b")).first()
    assert struct.unpack("<BIdd", bytes(r["w"])) == (1, 1, -3.25, 12.5)
    assert (r["b"]["xmin"], r["b"]["ymax"]) == (-3.25, 12.5)


def test_geodesic_offset_travels_the_distance_and_wraps(spark):
    d = spark.createDataFrame([(0.0, 179.9, 1.5707963), (89.5, 10.0, 0.3), (-45.0, -179.99, 4.7)], "lat double, lon double, b double")
    la, lo = geo.geodesic_offset("lat", "lon", 250.0, F.col("b"))
    r = d.select("*", la.alias("la"), lo.alias("lo")).select("lo", geo.haversine_km("lat", "lon", "la", "lo").alias("km")).toPandas()
    assert np.allclose(r.km, 250.0, atol=1e-6) and r.lo.between(-180, 180).all()


def test_antipodes_and_chord(spark):
    r = spark.createDataFrame([(10.0, 20.0)], "lat double, lon double").select(
        geo.haversine_km("lat", "lon", -F.col("lat"), F.col("lon") - 180).alias("h"),
        geo.chord_to_km(V.distance(geo.unit_xyz("lat", "lon"), geo.unit_xyz(-F.col("lat"), F.col("lon") - 180))).alias("c")).first()
    assert abs(r["h"] - math.pi * 6371) < 1e-3 and abs(r["c"] - math.pi * 6371) < 1e-3


def test_harmonics_closed_forms_and_orthogonality():
    lat = np.degrees(np.arcsin(np.random.default_rng(0).uniform(-1, 1, 200_000)))
    lon = np.random.default_rng(1).uniform(-180, 180, 200_000)
    h = geo.harmonics_matrix(lat, lon, 4)
    p00 = math.sqrt(1 / (4 * math.pi))
    assert np.allclose(h[:, 0], math.pi * p00)
    theta, phi = np.radians(np.clip(lat, -89.95, 89.95) + 90), np.radians(lon + 180)
    assert np.allclose(h[:, 2], math.pi * math.sqrt(3) * p00 * np.cos(theta))
    assert np.allclose(h[:, 3], math.sqrt(2) * math.sqrt(1.5) * p00 * np.sin(theta) * np.cos(phi))
    assert np.allclose(h[:, 1], math.sqrt(2) * math.sqrt(1.5) * p00 * np.sin(theta) * np.sin(phi))
    c = np.corrcoef(h[:, 1:].T)
    assert np.abs(c - np.eye(15)).max() < 0.02


def test_network_matches_a_plain_forward_pass(spark):
    w = X.demo_weights(width=16, depth=2, head=5)
    pts = spark.createDataFrame([(1.0, 2.0), (60.0, -170.0)], "lat double, lon double")
    got = np.array([r["vec"] for r in encoders.embed(pts, w, dim=None).collect()])
    xy = np.array([[r["p"][0], r["p"][1]] for r in pts.select(geo.equal_earth("lat", "lon").alias("p")).collect()])
    h = np.sin(30 * (xy.astype("f4") @ w["first.weight"].T + w["first.bias"]))
    for i in range(2):
        h = h + np.sin(h @ w[f"block{i}.weight"].T + w[f"block{i}.bias"])
    assert np.allclose(got, h, atol=1e-4)
    head = np.array([r["vec"] for r in encoders.embed(pts, w, dim=3, feature="head").collect()])
    assert np.allclose(head, (h @ w["head.weight"].T + w["head.bias"])[:, :3], atol=1e-4)


def test_network_argument_checks(spark):
    pts = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    w = X.demo_weights(width=16, use_year=True)
    with pytest.raises(ValueError):
        encoders.embed(pts, w)
    with pytest.raises(ValueError):
        encoders.embed(pts, X.demo_weights(width=16), dim=17)
    with pytest.raises(ValueError):
        encoders.sine_network(w, np.zeros(1), np.zeros(1), np.zeros(1), activation="relu")
    with pytest.raises(ValueError):
        encoders.network_shape({"other": np.zeros(2)})
    for act in ("finer", "hsiren"):
        assert np.isfinite(encoders.sine_network(w, np.ones(2), np.ones(2), np.full(2, 2020.0), activation=act)).all()


def test_unknown_encoder_and_dequantization_are_rejected(spark):
    with pytest.raises(ValueError):
        encoders.EncoderRegistry().encode(spark.range(1), ["nope"])
    with pytest.raises(ValueError):
        V.dequantize("v", "cubic")
    with pytest.raises(ValueError):
        V.prefix("v", 65, 64)
    with pytest.raises(ValueError):
        V.chunk("v", 8, 8)


def test_registered_numpy_encoder(spark):
    reg = encoders.EncoderRegistry()
    reg.register_function("sum", lambda la, lo: (la + lo)[:, None])
    r = reg.encode(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"), ["sum"])["sum"].first()
    assert r["vec"] == [3.0]


def test_zero_vector_and_nodata(spark):
    d = spark.createDataFrame([([0, 0],), ([3, 4],), ([-128, 1],)], "v array<tinyint>")
    r = d.select(V.l2_normalize(V.dequantize("v", "none")).alias("u"), V.nodata_to_nan("v", 2).alias("n")).collect()
    assert r[0]["u"] == [0.0, 0.0] and np.allclose(r[1]["u"], [0.6, 0.8])
    assert math.isnan(r[2]["n"][1]) and r[1]["n"] == [3.0, 4.0]


def test_ring_and_jitter(spark):
    p = spark.createDataFrame([(1, 10.0, 20.0)], "id long, lat double, lon double")
    ring = geo.ring_points(p, 4, 0.5).orderBy("member").toPandas()
    assert len(ring) == 5 and np.allclose(ring.lat, [10, 10, 10.5, 10, 9.5]) and np.allclose(ring.lon, [20, 20.5, 20, 19.5, 20])
    j = geo.jitter_points(spark.range(4000).withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0)), 1, 0.5, "id").where("member = 1").toPandas()
    assert abs(j.lat.std() - 0.5) < 0.03 and abs(np.corrcoef(j.lat, j.lon)[0, 1]) < 0.05


def test_ramp_ends_and_white(spark):
    r = spark.range(1).select(color.ramp_color(F.lit(0.0)).alias("a"), color.ramp_color(F.lit(1.0)).alias("b"),
                              color.lab_to_srgb(F.lit(100.0), F.lit(0.0), F.lit(0.0)).alias("w")).first()
    assert r["a"] == [68, 1, 84] and r["b"] == [253, 231, 37]
    assert all(abs(r["w"][c] - 1) < 0.01 for c in "rgb")


def test_tail_stretch_turns_the_longer_tail_up(spark):
    d = spark.range(101).select("id", (-F.col("id").cast("double")).alias("a"), (F.col("id") - 50.0).alias("b"), (F.col("id") * 1.0).alias("c"))
    stretch, sign = color.stretch_of(d, "a", "b", "c", "id", rule="tails")
    assert sign == [-1.0, 1.0, 1.0] and stretch == [2.0, 98.0, 48.0, 98.0]


def test_hilbert_key_is_computed_on_batches(spark):
    """Values against the loop for one point, missing ones included; no fold that is interpreted row by row."""
    from locavec.functions import geo

    def one(lat, lon, side=(1 << 16) - 1):
        x, y = (side if v is None else int(max(0.0, min(float(side), (v + h) / (2 * h) * side))) for v, h in ((lon, 180.0), (lat, 90.0)))
        d = 0
        for s in (1 << b for b in reversed(range(16))):
            hx, hy = bool(x & s), bool(y & s)
            quad = (2 if hy else 3) if hx else (1 if hy else 0)
            x, y, d = x & (s - 1), y & (s - 1), d + s * s * quad
            if quad == 3:
                x, y = s - 1 - x, s - 1 - y
            if not hy:
                x, y = y, x
        return d

    g = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in zip(g.uniform(-95, 95, 200), g.uniform(-185, 185, 200))] + [(None, 1.0), (1.0, None), (-90.0, -180.0), (90.0, 180.0)]
    d = spark.createDataFrame(rows, "lat double, lon double").coalesce(1).select("lat", "lon", geo.hilbert_key("lat", "lon").alias("h"))
    assert "aggregate(" not in d._jdf.queryExecution().toString()
    assert all(r["h"] == one(r["lat"], r["lon"]) for r in d.collect())
