"""The result summary as one job: manifest inputs, method names, filters, seed-averaged table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import summary
from ..session import cut_lineage
from ..sources import files

# Default grids of the published summaries.
CELLS = (0.0, 2.0, 10.0, 20.0, 40.0)
RADII = (0.0, 10.0, 25.0, 50.0, 100.0)
SEEDS = (0, 1, 2, 3, 4)


def summarize_manifest(spark: SparkSession, manifest: str, *, seeds: Sequence[int] = SEEDS, values: Sequence[float] | None = None,
                       methods: Sequence[str] | None = None, task_type: str | None = None, **kw) -> DataFrame:
    buffered = kw.get("buffered", False)
    # result rows are read by several checks: parse the CSV files once
    raw = cut_lineage(files.load_results(spark, manifest, seeds, buffered=buffered), "results")
    rows = cut_lineage(summary.method_rows(raw, buffered=buffered), "methods")
    if task_type:
        rows = rows.where(rows["task_type"] == task_type)
    if methods is None:
        methods = sorted(r["method"] for r in rows.select("method").distinct().collect())  # method names
    return summary.summarize(rows, seeds=seeds, values=values or (RADII if buffered else CELLS), methods=methods, **kw)
