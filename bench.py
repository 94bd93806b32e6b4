"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from locavec import fixtures as X  # noqa: E402
from locavec import registry  # noqa: E402
from locavec.operators import models, neighbours, stats  # noqa: E402
from locavec.plans import sweeps  # noqa: E402
from locavec.session import cut_lineage, local_session  # noqa: E402


def nested_12(spark, sf):
    """4 prefix, 4 chunk and 4 power profiles, 21 penalties, random inner folds."""
    v = X.vectors(spark, sf)
    d = sweeps.with_folds(v, 10.0, order="lex")
    grams = models.fold_grams(d, "v", ["y"], shift=stats.feature_shift(v, "v", ["y"]))
    pr = models.make_profiles(X.DIM, X.WIDTHS, models.CHUNK_BETAS, models.POWER_EXPONENTS, X.STARTS)
    return models.nested_score(d, "v", targets=["y"], profiles=pr, families=models.make_families(pr, X.DIM), rule="clamp", grams=grams)[1]


def knn_50(spark, sf):
    p = cut_lineage(sweeps.with_folds(X.points(spark, sf), 0.0), "folds")
    return neighbours.sphere_knn(p, k=50, payload=("y",))


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    q = registry.load()[0]
    runs = {
        "entry_alpha_path": q["mdl3_alpha_path"], "sphere_knn_50": knn_50, "nested_selection_12x21": nested_12,
        "teacher_annual_join": q["jon1_teacher_annual"], "macro_summary": q["agg6_macro_summary"],
        "idw": q["agg17_idw"], "buffer_exclusion": q["jon9_buffer_exclusion"], "spatial_folds": q["smp1_spatial_folds"],
        "point_in_polygon": q["jon4_point_in_polygon"], "raster_sample": q["jon5_raster_sample"], "distance_bins": q["agg12_distance_bins"],
        "percentiles": q["agg13_percentiles"], "storage_rollup": q["agg21_storage_rollup"], "canonicalize": q["prj1_canonicalize"],
        "sine_network": q["vec10_sine_network"],
    }
    # start the JVM's executor threads and the Python workers before the clock
    spark.range(0, 8 * 1000, 1, 8).mapInArrow(lambda it: it, "id long").selectExpr("sum(id)").collect()
    times = {}
    for name, fn in runs.items():
        t = time.perf_counter()
        fn(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF.rsplit("sf", 1)[-1], "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
