import numpy as np
import pytest
from pyspark.sql import functions as F

from locavec import fixtures as X
from locavec.operators import clean, joins


def _canon(spark, rows=((10.0, 20.0),)):
    return clean.canonicalize(spark.createDataFrame(list(rows), "lon double, lat double"), lon="lon", lat="lat")


def test_canonical_head_order_types_and_rest(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0, 2019, "train", "x", 9)], "key int, Lon double, Lat double, yr int, part string, note string, gone int")
    c = clean.canonicalize(d, lon="Lon", lat="Lat", timestamp="yr", unit="year", split="part", id="key", drop=("gone",))
    assert c.columns == [*clean.CANONICAL_COLUMNS, "note"]
    assert [t for _, t in c.dtypes[:6]] == ["double", "double", "bigint", "bigint", "string", "string"]
    r = c.first()
    assert r["timestamp"] == 1546300800000 and r["timestamp_end"] is None and r["id"] == "1" and r["split"] == "train"


def test_canonical_errors(spark):
    d = spark.createDataFrame([(1.0, 2.0, "a")], "lon double, lat double, s string")
    with pytest.raises(ValueError):
        clean.canonicalize(d, lon="lon", lat="lat", split="s", split_value="test")
    with pytest.raises(ValueError):
        clean.to_unix_ms("lon", "week")


def test_bad_years_become_null(spark):
    d = spark.createDataFrame([(0.0,), (10000.0,), (2019.5,), (None,), (1970.0,)], "y double")
    assert [r[0] for r in d.select(clean.to_unix_ms("y", "year")).collect()] == [None, None, None, None, 0]


def test_validate_names_every_problem(spark):
    clean.validate(_canon(spark), "ok")
    with pytest.raises(ValueError, match="missing"):
        clean.validate(spark.createDataFrame([(1.0,)], "lon double"), "t")
    for rows in ([(181.0, 0.0)], [(0.0, -91.0)], [(None, 0.0)], [(float("nan"), 0.0)]):
        with pytest.raises(ValueError):
            clean.validate(_canon(spark, rows), "t")


def test_column_choice(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "LATITUDE double, Long_deg double, meanP double, meanT double")
    assert clean.coordinate_names(d, by_prefix=True) == ("Long_deg", "LATITUDE")
    assert clean.temperature_name(d) == "meanT"
    assert clean.temperature_name(d.drop("meanT")) == "meanP"
    with pytest.raises(ValueError):
        clean.coordinate_names(d)
    t = spark.createDataFrame([(1, 1.0, 2.0, "s", 3.0, 4.0)], "ID int, lat double, lon double, txt string, Price double, roads_km double")
    assert clean.target_name(t, "roads") == "roads_km" and clean.target_name(t, "income") == "Price"
    assert clean.target_name(t.drop("Price"), "income") == "roads_km"
    with pytest.raises(ValueError):
        clean.target_name(t.select("ID", "txt"), "x")


def test_points_from_text(spark):
    d = spark.createDataFrame([("POINT (-12.5 3.25)",), ("POINT(1 2)",), ("POINT (1..2 3)",), (None,)], "g string")
    lon, lat = clean.parse_point("g")
    r = d.select(lon.alias("x"), lat.alias("y")).collect()
    assert tuple(r[0]) == (-12.5, 3.25) and all(v["x"] is None for v in r[1:])


def test_melt_requires_its_columns(spark):
    d = spark.createDataFrame([(1, 2.0, float("nan"))], "id int, a double, b double")
    assert [tuple(r) for r in clean.melt_tasks(d, ["id"], ["a", "b"]).collect()] == [(1, "a", 2.0)]
    with pytest.raises(ValueError):
        clean.melt_tasks(d, ["id"], ["a", "c"])


def test_sentinels_keep_nulls(spark):
    d = spark.createDataFrame([(-999.0,), (None,), (5.0,)], "v double")
    assert clean.drop_value(d, "v", -999.0).count() == 2


def test_task_type_rule(spark):
    kind = lambda rows: clean.infer_task_type(spark.createDataFrame([(v,) for v in rows], "y double"), "y").first()["task_type"]
    assert kind([1.0, 2.0, 2.0]) == "classification"
    assert kind([1.0, 2.5]) == "regression" and kind([1.0, float("nan")]) == "regression"
    assert kind([float(i) for i in range(101)]) == "regression" and kind([float(i) for i in range(100)]) == "classification"


def test_fill_coordinates_takes_the_first_complete_sibling(spark):
    base = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "id int, y double")
    a = spark.createDataFrame([(1, None, 1.0), (2, 10.0, 11.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([(1, 20.0, 21.0), (2, 30.0, 31.0)], "id int, lat double, lon double")
    got, lost = clean.fill_coordinates(base, [a, b])
    assert {r["id"]: r["lat"] for r in got.collect()} == {1: 20.0, 2: 10.0} and [r["id"] for r in lost.collect()] == [3]


def test_sorted_codes(spark):
    d = spark.createDataFrame([(i, w) for i, w in enumerate(["b", "aa", "ab", "b", "a", "zz", None])], "id int, w string")
    got = {r["w"]: r["code"] for r in clean.sorted_codes(d, "w", "id").collect()}
    assert got == {"a": 0, "aa": 1, "ab": 2, "b": 3, "zz": 4, None: None}


# --------------------------------------------------------------------------- annual join

def test_annual_join_accepts_good_and_names_each_fault(spark, sf):
    t, a = X.teachers(spark, sf), X.annual(spark, sf)
    assert joins.join_annual(t, a, ["ta"]).count() == t.count()
    i, y = F.col("point_id"), F.col("year")
    gap = F.concat(F.slice("aef", 1, 63), F.array(F.lit(-128).cast("tinyint")))
    faults = {
        "missing_years": (t, a.where(~((i == 3) & (y == 2018)))),
        "duplicate_years": (t, a.unionByName(a.where((i == 3) & (y == 2018)))),
        "orphans": (t, a.unionByName(a.where(i == 3).withColumn("point_id", i + 100000))),
        "nodata_vectors": (t, a.withColumn("aef", F.when((i == 3) & (y == 2018), gap).otherwise(F.col("aef")))),
        "null_vectors": (t, a.withColumn("aef", F.when(~((i == 3) & (y == 2018)), F.col("aef")))),
        "duplicate_points": (t.unionByName(t.where(i == 3)), a),
        "bad_teachers": (t.withColumn("ta", F.when(i == 3, F.array(F.lit(float("nan")))).otherwise(F.col("ta"))), a),
    }
    for name, (tt, aa) in faults.items():
        with pytest.raises(ValueError, match=name):
            joins.join_annual(tt, aa, ["ta"])


def test_half_precision(spark):
    d = spark.createDataFrame([([0.1, 1 / 3],)], "v array<double>")
    got = d.select(joins.half_precision("v").alias("h")).first()["h"]
    assert got == [float(np.float16(0.1)), float(np.float16(1 / 3))]


# --------------------------------------------------------------------------- polygons and rasters

def test_holes_shared_edges_and_boundaries(spark):
    pts = spark.createDataFrame([(0, -30.0, 0.0), (1, -125.0, -10.0), (2, -150.0, -10.0), (3, 0.0, 10.0), (4, 0.001, 10.0), (5, 110.0, 49.0), (6, 81.0, 49.0),
                                 (7, -60.0, 0.0), (8, -30.0, -40.0)], "id int, lon double, lat double")
    got = {r["id"]: r["label"] for r in joins.point_in_polygon(pts, X.polygons(spark)).collect()}
    assert got == {0: "west", 2: "ring", 4: "east", 5: "tri"}
    for cell in (1.0, 33.0, 200.0):
        assert {r["id"] for r in joins.on_land(pts, X.polygons(spark), cell_deg=cell).collect()} == {0, 2, 4, 5}


def test_raster_clamps_and_masks(spark):
    pts = spark.createDataFrame([(0, -180.0, 90.0), (1, 180.0, -90.0), (2, 0.5, 0.5)], "id int, lon double, lat double")
    d = joins.sample_raster(pts, X.raster_tiles(spark), x0=-180.0, y0=90.0, dx=1.0, dy=-1.0, height=180, width=360, tile=20, nodata=-1)
    want = lambda r, c: None if (r * 31 + c * 17) % 251 % 13 == 0 else float((r * 31 + c * 17) % 251)
    assert {r["id"]: r["value"] for r in d.collect()} == {0: want(0, 0), 1: want(179, 359), 2: want(89, 180)}


# --------------------------------------------------------------------------- containment

def _count(spark, src, dst, **kw):
    s = spark.createDataFrame(src, "lon double, lat double, v double")
    t = spark.createDataFrame(dst, "lon double, lat double, v double")
    r = joins.containment(s, t, "v", **kw).first()
    return r["coordinates"], r["missing"], r["bad"]


def test_multiset_containment(spark):
    nan = float("nan")
    assert _count(spark, [(1.0, 1.0, 5.0), (1.0, 1.0, 5.0)], [(1.0, 1.0, 5.0)] * 3) == (1, 0, 0)
    assert _count(spark, [(1.0, 1.0, 5.0), (1.0, 1.0, 5.0)], [(1.0, 1.0, 5.0)]) == (1, 0, 1)
    assert _count(spark, [(1.0, 1.0, 5.0)], [(1.0, 1.0, 5.00001)]) == (1, 0, 0)
    assert _count(spark, [(1.0, 1.0, 5.0)], [(1.0, 1.0, 5.1)]) == (1, 0, 1)
    assert _count(spark, [(1.0, 1.0, nan)], [(1.0, 1.0, nan)]) == (1, 0, 0)
    assert _count(spark, [(1.0000001, 1.0, 5.0), (2.0, 2.0, 1.0)], [(1.0, 1.0, 5.0)]) == (2, 1, 0)
    assert _count(spark, [(1.0, 1.0, 5.0), (1.0, 1.0, 6.0)], [(1.0, 1.0, 5.00001), (1.0, 1.0, 6.00001)]) == (1, 0, 0)
    assert _count(spark, [(1.0, 1.0, 5.0), (1.0, 1.0, 6.0)], [(1.0, 1.0, 5.00001), (1.0, 1.0, 5.00002)]) == (1, 0, 1)
    with pytest.raises(AssertionError):
        s = spark.createDataFrame([(1.0, 1.0, 5.0)], "lon double, lat double, v double")
        joins.check_containment("t", s, s.withColumn("v", F.col("v") + 1), "v")
