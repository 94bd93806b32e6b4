import numpy as np
from pyspark.sql import functions as F

from locavec.operators import folds as FO
from locavec.operators import primitives as P


def _rows(spark, n, parts):
    return spark.range(n).withColumn("g", F.col("id") % 3).repartition(parts)


def test_hash_rank_is_a_permutation_independent_of_partitioning(spark):
    one = P.hash_rank(_rows(spark, 500, 1), ["id"], seed=3).select("id", "rank").toPandas().sort_values("id")
    many = P.hash_rank(_rows(spark, 500, 8), ["id"], seed=3).select("id", "rank").toPandas().sort_values("id")
    assert sorted(one["rank"]) == list(range(500))
    assert one["rank"].tolist() == many["rank"].tolist()
    other = P.hash_rank(_rows(spark, 500, 8), ["id"], seed=4).toPandas().sort_values("id")
    assert other["rank"].tolist() != one["rank"].tolist()


def test_value_rank_splits_a_hot_value_and_orders_ties_by_id(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 101).cast("double")))
    got = P.value_rank(df, "k", "id").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(3000))
    assert list(got["id"]) == list(got.sort_values(["k", "id"])["id"])


def test_value_rank_by_group_with_nulls(spark):
    df = _rows(spark, 90, 3).withColumn("k", F.when(F.col("id") % 10 == 0, None).otherwise(-F.col("id").cast("double")))
    got = P.value_rank(df, "k", "id", group=["g"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(30))
        nulls = part["k"].isna().to_numpy()
        assert not nulls[nulls.sum():].any()  # nulls first
        assert (np.diff(part["k"].dropna()) >= 0).all()


def test_prefix_sum(spark):
    df = spark.range(400).withColumn("w", (F.col("id") % 7).cast("double"))
    got = P.prefix_sum(df, "id", "w").toPandas().sort_values("id")
    assert np.allclose(got["cum"], np.cumsum(got["w"]))


def test_uniform_and_normal_draws(spark):
    d = spark.range(20000).select(P.hash_uniform("id", seed=1).alias("u"), P.hash_normal("id", seed=1).alias("z")).toPandas()
    assert 0 <= d.u.min() and d.u.max() < 1 and abs(d.u.mean() - 0.5) < 0.01
    assert abs(d.z.mean()) < 0.03 and abs(d.z.std() - 1) < 0.03


def test_spatial_folds_never_split_a_cell(spark, sf):
    from locavec import fixtures as X
    from locavec.functions import geo

    a, b = geo.grid_cell("lat", "lon", 20.0)
    for order in ("hash", "lex"):
        d = FO.spatial_folds(X.points(spark, sf), cell_deg=20.0, seed=2, order=order).withColumn("a", a).withColumn("b", b)
        cells = d.select("a", "b", "fold").distinct()
        assert cells.count() == cells.select("a", "b").distinct().count()
        n = [r["count"] for r in cells.groupBy("fold").count().collect()]
        assert max(n) - min(n) <= 1
        assert d.count() == X.points(spark, sf).count()


def test_weighted_draws_follow_the_weights_even_with_one_heavy_row(spark):
    items = spark.range(50).select(F.col("id").alias("city"), F.when(F.col("id") == 7, 25.0).otherwise(1.0).alias("w"))
    got = FO.weighted_draws(items, spark.range(4000).select(F.col("id").alias("draw")), id_col="city", weight="w", draw_col="draw", seed=1)
    d = got.toPandas()
    assert len(d) == 4000 and d.draw.is_unique
    share = (d.city == 7).mean()
    assert abs(share - 25 / 74) < 0.03


def test_matched_deletion_is_nested_and_exact(spark):
    df = _rows(spark, 300, 4)
    kept = {}
    for n in (10, 40):
        gone = spark.createDataFrame([(0, n), (1, n), (2, 0)], "g long, n_removed long")
        d = FO.matched_deletion(df, gone, "id", keys=("g",), seed=5).toPandas()
        assert d[d.g == 0].kept.sum() == 100 - n and d[d.g == 2].kept.all()
        kept[n] = set(d[d.kept].id)
    assert kept[40] <= kept[10]


def test_fixed_sample_and_sphere_points(spark):
    assert P.fixed_sample(_rows(spark, 100, 2), 30, ["id"]).count() == 30
    p = FO.sphere_points(spark.range(20000), "id").toPandas()
    z = np.sin(np.radians(p.lat))
    assert abs(z.mean()) < 0.02 and abs((z**2).mean() - 1 / 3) < 0.02 and p.lon.between(-180, 180).all()
