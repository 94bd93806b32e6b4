"""Datasets of the evaluation suite: every family is a few rows of specs over canonical tables.

A spec says which columns are tasks, which rows belong, how a label is transformed and which rows are the official test set. It compiles
to one projection of its table (wide, for the probes) and one unpivot of that (long, for reports). Tables come from ``read``, a function
from a canonical table's name to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.summary import category
from ..sources.catalog import USAVARS_LABELS, Suite
from . import sweeps

Read = Callable[[str], DataFrame]


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset. ``tasks`` maps columns to task names; with ``rule`` the columns are found in the table instead."""

    name: str
    table: str
    tasks: tuple[tuple[str, str], ...] = ()
    rule: str | None = None            # "rest", "temperature" or "label"
    kind: str = "regression"           # "regression", "classification", or "infer" from the values
    nodata: tuple[str, float] | None = None   # rows where this column holds this value are left out
    present: bool = False              # rows without a label or coordinates are left out
    log: bool = False                  # log(1 + label)
    split: bool = False                # canonical column ``split`` marks the test rows
    scheme: bool = False               # a requested scheme names a column ``<scheme>_split``
    siblings: tuple[str, ...] = ()     # tables that complete missing coordinates by id
    year: bool = False                 # year of the canonical timestamp, where any row has one


# Dataset names, label columns and sentinels of the families.
PDFM_OTHER = ("place", "county", "state", "latitude", "longitude", "Count_Person", "imputation_split", "superresolution_split", "extrapolation_split")
DHS_INDICES = (("asset", "asset_index"), ("water", "water_index"), ("sanitation", "sanitation_index"), ("child_mortality", "under5_mort"),
               ("women_edu", "women_edu"), ("women_bmi", "women_bmi"))
PLACES_MEASURES = (("phys_health", "phlth"), ("diabetes", "diabetes"), ("copd", "copd"), ("cancer", "cancer"), ("chd", "chd"), ("mental_health", "mhlth"),
                   ("checkup", "checkup"), ("sleep_lt7", "sleep"), ("asthma", "casthma"), ("obesity", "obesity"), ("smoking", "csmoking"), ("high_chol", "highchol"))
USAVARS_NODATA = -999.0
FAMILIES: dict[str, tuple[DatasetSpec, ...]] = {
    "pdfm": (DatasetSpec("pdfm-conus27", "pdfm_conus27", rule="rest", scheme=True),),
    "air_temp": (DatasetSpec("satclip-air-temp", "air_temp", rule="temperature"),),
    "calhousing": (DatasetSpec("california-housing", "california_housing", (("MedHouseVal", "median_house_value"),)),),
    "sustainbench": tuple(DatasetSpec(f"sustainbench-{k}", "sustainbench", ((c, c),), present=True, split=True) for k, c in DHS_INDICES),
    "mosaiks": tuple(DatasetSpec(f"mosaiks-{k}", f"usavars_{k}", rule="label", log=k in clean.LOG_LABELS, siblings=tuple(f"usavars_{s}" for s in USAVARS_LABELS))
                     for k in USAVARS_LABELS),
    "satclip_official": (
        DatasetSpec("satclip-country", "satclip_country", (("country", "country"),), kind="classification", nodata=("country", 0)),
        DatasetSpec("satclip-ecoregion", "satclip_ecoregion", (("ecoregion_class_index", "ecoregion_class_index"),), kind="classification", nodata=("ecoregion_class_index", -1)),
        DatasetSpec("satclip-biome", "satclip_ecoregion", (("biome_class_index", "biome_class_index"),), kind="classification", nodata=("ecoregion_class_index", -1)),
        DatasetSpec("satclip-population", "satclip_population", (("log_population", "log_population"),)),
        DatasetSpec("satclip-elevation", "satclip_elevation", (("elevation", "elevation"),)),
    ),
    "worldclim": tuple(DatasetSpec(f"worldclim-{v}", "worldclim_bio", ((v, v),)) for v in ("bio1", "bio12")),
    "soilgrids": tuple(DatasetSpec(f"soilgrids-{v}", "soilgrids", ((v, v),)) for v in ("soc", "phh2o")),
    "cdc_places": tuple(DatasetSpec(f"places-{k}", "cdc_places", ((f"{p}_crudeprev", f"{p}_crudeprev"),), present=True) for k, p in PLACES_MEASURES),
}
DEEPMIND = "deepmind"


def deepmind_specs(stems: Sequence[str]) -> tuple[DatasetSpec, ...]:
    """One dataset per evaluation file, whose label is its task; the file names are not fixed."""
    return tuple(DatasetSpec(f"dm-{s}", f"dm_{s}", (("label", s),), kind="infer", year=True) for s in stems)


@dataclass(frozen=True)
class Dataset:
    """``table``: row_id, lat, lon, year, is_test and one column a task (double, or the source type of a class)."""

    name: str
    table: DataFrame
    tasks: tuple[str, ...]
    task_type: str
    official: bool

    def long(self) -> DataFrame:
        """(benchmark, family, task, task_type, row_id, lat, lon, year, is_test, value): a row for every label that is there."""
        keep = ["row_id", "lat", "lon", "year", "is_test"]
        kind = "double" if self.task_type == "regression" else "string"
        wide = self.table.select(*keep, *[F.col(f"`{t}`").cast(kind).cast("string").alias(t) for t in self.tasks])
        rows = wide.unpivot(keep, list(self.tasks), "task", "value").where("value IS NOT NULL AND value <> 'NaN'")
        return rows.select(F.lit(self.name).alias("benchmark"), category(F.lit(self.name)).alias("family"), "task", F.lit(self.task_type).alias("task_type"), *keep, "value")


def _columns(df: DataFrame, spec: DatasetSpec) -> tuple[tuple[str, str], ...]:
    """(column, task) of the labels."""
    if spec.rule == "rest":
        other = {*PDFM_OTHER, *clean.CANONICAL_COLUMNS}
        return tuple((c, c) for c in df.columns if c not in other)
    if spec.rule == "temperature":
        return ((clean.temperature_name(df), "air_temperature"),)
    if spec.rule == "label":
        label = spec.name.split("-")[1]
        return ((clean.target_name(df, label), label),)
    gone = [c for c, _ in spec.tasks if c not in df.columns]
    if gone:
        raise ValueError(f"table {spec.table!r} of {spec.name!r} has no column {gone}; it has {df.columns}")
    return spec.tasks


def compile_dataset(spec: DatasetSpec, read: Read, scheme: str | None = None) -> Dataset:
    """The dataset of a spec. Reads no rows, unless the kind of the task or the presence of years must be found out."""
    df = read(spec.table)
    labels = _columns(df, spec)
    if spec.siblings:
        df = _completed(df, [read(s) for s in spec.siblings])
    rows = F.lit(True)
    if spec.nodata:
        rows = rows & ~F.col(spec.nodata[0]).eqNullSafe(F.lit(spec.nodata[1]))
    if spec.rule == "label":
        rows = rows & ~F.col(f"`{labels[0][0]}`").eqNullSafe(F.lit(USAVARS_NODATA))
    if spec.present:
        rows = rows & F.col(f"`{labels[0][0]}`").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    df = df.where(rows)
    kind = spec.kind if spec.kind != "infer" else clean.infer_task_type(df.select(F.col(labels[0][0]).cast("double").alias("y")), "y").first()["task_type"]
    official = spec.split or (spec.scheme and scheme is not None)
    test = clean.is_test(df, scheme if spec.scheme else None) if official else F.lit(False)
    year = clean.year_of_ms("timestamp") if spec.year else F.lit(None)

    def value(column: str) -> Column:
        c = F.col(f"`{column}`")
        if kind == "classification":
            return c.cast("long") if spec.kind == "infer" else c
        return F.log1p(c.cast("double")) if spec.log else c.cast("double")

    table = df.select(F.monotonically_increasing_id().alias("row_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                      year.cast("int").alias("year"), test.alias("is_test"), *[value(c).alias(t) for c, t in labels])
    name = f"{spec.name}-{scheme}" if spec.scheme and scheme else spec.name
    return Dataset(name, table, tuple(t for _, t in labels), kind, official)


def _completed(df: DataFrame, siblings: Sequence[DataFrame]) -> DataFrame:
    """Rows without coordinates take those of their id in the sibling tables (the first complete ones); other rows stay as they are."""
    have = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    found, _ = clean.fill_coordinates(df.where(~have), [s.select("id", "lat", "lon") for s in siblings])
    return df.where(have).unionByName(found)


def load_family(family: str, read: Read, scheme: str | None = None, stems: Sequence[str] = ()) -> list[Dataset]:
    """All datasets of a family; ``stems`` name the evaluation files of the deepmind family, ``scheme`` an official split of pdfm."""
    specs = deepmind_specs(stems) if family == DEEPMIND else FAMILIES.get(family)
    if specs is None:
        raise ValueError(f"unknown dataset family {family!r}; known: {[*FAMILIES, DEEPMIND]}")
    return [compile_dataset(s, read, scheme) for s in specs]


def suite(read: Read, scheme: str | None = None, stems: Sequence[str] = ()) -> Suite:
    """The ten families as a suite of long task tables."""
    out = Suite()
    for family in (*FAMILIES, DEEPMIND):
        out.register(family, lambda f=family: sweeps.union([d.long() for d in load_family(f, read, scheme, stems)]))
    return out


def evaluate(dataset: Dataset, encode: Callable[[DataFrame], DataFrame], features: str, **how) -> DataFrame:
    """Task scores of a dataset (benchmark, task, task_type, score) on the vectors that ``encode`` adds; its official split is used."""
    d = encode(dataset.table.withColumnRenamed("row_id", "id"))
    scores = sweeps.evaluate_tasks(d, features, dataset.tasks, task_type=dataset.task_type, test_flag="is_test" if dataset.official else None, **how)
    return scores.select(F.lit(dataset.name).alias("benchmark"), "task", F.lit(dataset.task_type).alias("task_type"), "score")
