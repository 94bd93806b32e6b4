"""Whitening against NumPy in floating point and Python integers."""

import numpy as np
from pyspark.sql import functions as F

from locavec.llm import queries, whiten

SF = "/root/testdata/sf0.001"


def test_popcounts_are_exact_products():
    rng = np.random.default_rng(5)
    for rows, dims, bits in ((1, 1, 1), (63, 3, 4), (64, 2, 9), (200, 5, 13), (70, 2, 64)):
        u = rng.integers(0, (1 << bits) - 1, (rows, dims), dtype=np.uint64, endpoint=True)
        c = whiten.plane_counts(u, bits)
        big = u.astype(object)
        for i in range(dims):
            for j in range(i, dims):
                assert sum(int(n) << s for s, n in enumerate(c[i, j])) == int((big[:, i] * big[:, j]).sum())


def expected(vectors, components=4):
    x = np.floor(256 * np.stack(vectors)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ (q / np.sqrt(e)), e / np.trace(z.T @ z / n)


def check(rows, ids, vectors, components=4):
    n, far, y, part = expected(vectors, components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * components
    for k in range(components):
        mine = np.array([got[i, k + 1]["whitened"] for i in ids])
        assert np.allclose(mine, y[:, k] * np.sign(mine @ y[:, k]), atol=1e-9)
        for i, d in zip(ids, far):
            r = got[i, k + 1]
            assert r["n"] == n and r["deviation"] == d and abs(r["explained"] - part[k]) < 1e-12 and r["identity_error"] < 1e-9


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.QUERIES["op12_embedding_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows],
          [np.array(r["embedding"], np.float64) for r in rows])


def test_invalid_repeated_and_unequal_vectors(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=6).tolist() for _ in range(50)]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[0]) for i in range(40)]  # one vector holds a third of the rows
    short = [(200 + i, rng.normal(size=2).tolist()) for i in range(9)]
    bad = [(-1, None), (-2, [None] * 6), (-3, [float("nan")] + [0.0] * 5), (-4, [float("inf")] * 6), (-5, [])]
    df = spark.createDataFrame(rows + short + bad, "vec_id long, embedding array<double>").withColumn("whitened", F.lit("x")).withColumn("n", F.lit(1))
    got = whiten.whiten(df).collect()
    ids = [i for i, _ in rows]
    check([r for r in got if r["vec_id"] < 200], ids, [v for _, v in rows])
    check([r for r in got if r["vec_id"] >= 200], [i for i, _ in short], [v for _, v in short], 2)


def test_empty_constant_and_huge(spark):
    ddl = "vec_id long, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ddl)).count() == 0
    huge = whiten.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (None, [-1e300, 2.0]), (3, [5.0, 2.0])], ddl)).collect()
    assert len(huge) in (3, 6) and all(r["n"] == 3 and np.isfinite(r["whitened"]) for r in huge)
    assert [r["deviation"] for r in huge if r["vec_id"] == 1][0] is None  # beyond a long
