"""Dataset specs on small canonical tables."""

import math

import pytest
from pyspark.sql import functions as F

from locavec.plans import datasets as D
from locavec.sources.catalog import USAVARS_LABELS

HEAD = "lon double, lat double, timestamp bigint, timestamp_end bigint, split string, id string"


def canonical(spark, columns, rows):
    return spark.createDataFrame(rows, f"{HEAD}, {columns}")


def test_sentinels_logs_and_coordinates_of_siblings(spark):
    full = lambda i: (float(i), float(-i), None, None, None, str(i))
    bare = lambda i: (None, None, None, None, None, str(i))
    tables = {f"usavars_{k}": canonical(spark, "code int, price double", [(*full(i), 5, float(i)) for i in range(4)]) for k in USAVARS_LABELS}
    tables["usavars_income"] = canonical(spark, "code int, price double", [(*bare(1), 5, 9.0), (*full(2), 5, -999.0), (*full(3), 5, 1.0), (*bare(8), 5, 1.0), (*full(6), 5, None)])
    got = {d.name: d for d in D.load_family("mosaiks", tables.__getitem__)}
    assert sorted(got) == sorted(f"mosaiks-{k}" for k in USAVARS_LABELS)
    rows = {(r["lat"], r["lon"]): r["income"] for r in got["mosaiks-income"].table.collect()}
    # the sentinel goes, id 1 is completed, id 8 has no coordinates anywhere, a missing label stays (and is no task row)
    assert rows == {(-1.0, 1.0): pytest.approx(math.log1p(9.0)), (-3.0, 3.0): pytest.approx(math.log1p(1.0)), (-6.0, 6.0): None}
    assert got["mosaiks-roads"].table.agg(F.sum("roads")).first()[0] == 6.0 and got["mosaiks-income"].long().count() == 2


def test_kinds_years_and_splits(spark):
    ms = 1_500_000_000_000
    whole = canonical(spark, "label double", [(0.0, float(i), ms if i else None, None, None, None, float(i % 3)) for i in range(9)])
    broken = whole.withColumn("label", F.when(F.col("lat") != 4, F.col("label")))
    a, b = (D.load_family("deepmind", lambda _, t=t: t, stems=["crop"])[0] for t in (whole, broken))
    assert (a.name, a.tasks, a.task_type, a.official) == ("dm-crop", ("crop",), "classification", False)
    assert dict(a.table.dtypes)["crop"] == "bigint" and {r["year"] for r in a.table.collect()} == {None, 2017}
    assert b.task_type == "regression" and b.long().count() == 8
    pdfm = canonical(spark, "county string, Count_Person int, imputation_split string, b double, a double",
                     [(0.0, 0.0, None, None, "test", None, "c", 1, s, 1.0, 2.0) for s in ("test", "train", None)])
    plain, official = (D.load_family("pdfm", lambda _: pdfm, scheme)[0] for scheme in (None, "imputation"))
    assert plain.tasks == ("b", "a") and not plain.official and official.name == "pdfm-conus27-imputation" and official.official
    assert sorted(r["is_test"] for r in official.table.collect()) == [False, False, True] and not plain.table.where("is_test").count()


def test_missing_labels_and_coordinates(spark):
    rows = [(0.0, 1.0, None, None, s, str(i), y, 1.0, 1.0, 1.0, 1.0, 1.0) for i, (s, y) in enumerate([("test", 1.0), ("trainval", None), (None, 2.0)])]
    rows.append((0.0, None, None, None, "test", "9", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    t = canonical(spark, ", ".join(f"{c} double" for _, c in D.DHS_INDICES), rows)
    got = {d.name: d.table.orderBy("row_id").collect() for d in D.load_family("sustainbench", lambda _: t)}
    assert [(r["asset_index"], r["is_test"]) for r in got["sustainbench-asset"]] == [(1.0, True), (2.0, False)]
    assert len(got) == 6 and len(got["sustainbench-water"]) == 3


def test_faults_are_named(spark):
    empty = canonical(spark, "other int", [])
    with pytest.raises(ValueError, match="MedHouseVal"):
        D.load_family("calhousing", lambda _: empty)
    with pytest.raises(ValueError, match="unknown dataset family 'x'"):
        D.load_family("x", lambda _: empty)
    with pytest.raises(RuntimeError, match="'calhousing' failed"):
        D.suite(lambda _: empty).gather(["calhousing"])
    with pytest.raises(ValueError, match="not recognized"):
        D.suite(lambda _: empty).gather(["calhousin"])
    one = canonical(spark, "country int", [])
    two = canonical(spark, "ecoregion_class_index int, biome_class_index int, log_population double, elevation double", [])
    assert [d.long().count() for d in D.load_family("satclip_official", lambda t: one if t == "satclip_country" else two)] == [0] * 5


def test_evaluation_uses_the_official_rows(spark):
    rows = [(float(i % 7), float(i % 11), None, None, "test" if i % 4 == 0 else "trainval", str(i), *[float(i % 7 - 2 * (i % 11))] * 6) for i in range(120)]
    t = canonical(spark, ", ".join(f"{c} double" for _, c in D.DHS_INDICES), rows)
    asset = D.load_family("sustainbench", lambda _: t)[0]
    got = {r["task"]: r for r in D.evaluate(asset, lambda d: d.withColumn("v", F.array("lat", "lon")), "v", alphas=(1e-4, 1.0)).collect()}
    assert got["asset_index"]["score"] > 0.999 and got["MEAN"]["benchmark"] == "sustainbench-asset"
