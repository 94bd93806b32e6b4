"""Queries for the dataset families of the evaluation suite, on canonical tables derived from the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..plans import datasets, sweeps
from ..sources.catalog import USAVARS_LABELS
from .core import PTS, R, W, query, r

_STEMS = ("crops", "height")


def tables(spark, sf) -> dict[str, DataFrame]:
    """One canonical table for every source of the ten families."""
    p = X.points(spark, sf)
    i, y = F.col("id"), F.col("y")
    null = lambda t: F.lit(None).cast(t)

    def canonical(**cols):
        head = dict(lon=F.col("lon"), lat=F.col("lat"), timestamp=null("bigint"), timestamp_end=null("bigint"), split=null("string"), id=null("string"))
        return p.select(*[c.alias(n) for n, c in (head | cols).items()])

    gone = lambda k, c: F.when(i % k != 0, c)
    ms = (F.col("year") - 1970).cast("long") * 31557600000
    out = {
        "pdfm_conus27": canonical(place=F.lit("p"), state=F.lit("s"), Count_Person=i, imputation_split=F.when(i % 5 == 0, "test").otherwise("train"), heat=y, rent=gone(7, y * 2)),
        "air_temp": canonical(meanP=y, meanT=y / 100),
        "california_housing": canonical(MedHouseVal=y),
        "satclip_country": canonical(country=i % 6),
        "satclip_ecoregion": canonical(ecoregion_class_index=i % 9 - 1, biome_class_index=i % 4),
        "satclip_population": canonical(log_population=y),
        "satclip_elevation": canonical(elevation=gone(13, y)),
        "sustainbench": canonical(split=F.when(i % 4 == 0, "test").otherwise("trainval"), id=i.cast("string"), timestamp=ms,
                                  **{c: gone(5 + k, y + k) for k, (_, c) in enumerate(datasets.DHS_INDICES)}),
        "worldclim_bio": canonical(bio1=y, bio12=y + 1),
        "soilgrids": canonical(soc=y, phh2o=gone(3, y)),
        "cdc_places": canonical(lat=gone(19, F.col("lat")), **{f"{m}_crudeprev": gone(5 + k, y + k) for k, (_, m) in enumerate(datasets.PLACES_MEASURES)}),
        "dm_crops": canonical(timestamp=gone(3, ms), label=i % 4),
        "dm_height": canonical(label=y),
    }
    for k, label in enumerate(USAVARS_LABELS):
        hole = (i % 10 == 0) & F.lit(label in ("income", "housing"))
        out[f"usavars_{label}"] = canonical(id=i.cast("string"), lat=F.when(~hole, F.col("lat")), lon=F.when(~hole, F.col("lon")),
                                            zone=i, **{f"{label}_value": F.when(i % 17 == 0, -999.0).otherwise(F.abs(y) + k)})
    return out


def _sql() -> str:
    """(benchmark, task, task_type, is_test, lat, value) of every label, family by family."""
    one = lambda name, task, value, kind="regression", test="false", where="true", lat="lat": (
        f"SELECT '{name}' AS benchmark, '{task}' AS task, '{kind}' AS task_type, {test} AS is_test, {lat} AS lat, ({value})::DOUBLE AS v FROM pts WHERE {where}")
    parts = [
        one("pdfm-conus27-imputation", "heat", "y", test="id%5=0"), one("pdfm-conus27-imputation", "rent", "2*y", test="id%5=0", where="id%7<>0"),
        one("satclip-air-temp", "air_temperature", "y/100"), one("california-housing", "median_house_value", "y"),
        one("satclip-country", "country", "id%6", "classification", where="id%6<>0"),
        one("satclip-ecoregion", "ecoregion_class_index", "id%9-1", "classification", where="id%9<>0"),
        one("satclip-biome", "biome_class_index", "id%4", "classification", where="id%9<>0"),
        one("satclip-population", "log_population", "y"), one("satclip-elevation", "elevation", "y", where="id%13<>0"),
        one("worldclim-bio1", "bio1", "y"), one("worldclim-bio12", "bio12", "y+1"), one("soilgrids-soc", "soc", "y"), one("soilgrids-phh2o", "phh2o", "y", where="id%3<>0"),
        one("dm-crops", "crops", "id%4", "classification"), one("dm-height", "height", "y"),
        *[one(f"sustainbench-{k}", c, f"y+{n}", test="id%4=0", where=f"id%{5 + n}<>0") for n, (k, c) in enumerate(datasets.DHS_INDICES)],
        *[one(f"places-{k}", f"{m}_crudeprev", f"y+{n}", where=f"id%{5 + n}<>0 AND id%19<>0") for n, (k, m) in enumerate(datasets.PLACES_MEASURES)],
        *[one(f"mosaiks-{k}", k, f"ln(1+abs(y)+{n})" if k in ("population", "income", "nightlights", "housing") else f"abs(y)+{n}", where="id%17<>0") for n, k in enumerate(USAVARS_LABELS)],
    ]
    return W(PTS, "l AS (" + " UNION ALL ".join(parts) + ")") + (
        f"SELECT benchmark, task, task_type, count(*)::BIGINT AS n, count(*) FILTER (is_test)::BIGINT AS n_test, {r('sum(lat)', 3)} AS lat, {r('sum(v)', 3)} AS total, count(DISTINCT v)::BIGINT AS n_values FROM l GROUP BY 1,2,3")


@query("src14_dataset_families", _sql())
def families(spark, sf):
    """Every dataset of the ten families through the suite, one row a task."""
    read = tables(spark, sf)
    long = datasets.suite(read.__getitem__, "imputation", _STEMS).gather()
    v = F.col("value").cast("double")
    return long.groupBy("benchmark", "task", "task_type").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("n_test"), R(F.sum("lat"), 3).alias("lat"), R(F.sum(v), 3).alias("total"), F.count_distinct(v).alias("n_values"))


@query("mdl11_dataset_scores")
def scores(spark, sf):
    """Datasets of three kinds (numbers, an official split, classes) through the task evaluator, on coordinates as features."""
    read = tables(spark, sf).__getitem__
    encode = lambda d: d.withColumn("v", F.array("lat", "lon", F.col("lat") * F.col("lon") / 100))
    chosen = [*datasets.load_family("air_temp", read), *datasets.load_family("pdfm", read, "imputation"), datasets.load_family("satclip_official", read)[0]]
    return sweeps.union([datasets.evaluate(d, encode, "v") for d in chosen]).select("benchmark", "task", "task_type", R("score", 5).alias("score"))
