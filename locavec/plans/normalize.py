"""Source normalization driven by a table of specs, its check, and the training-point build."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders, geo
from ..operators import clean, folds, joins
from ..sources import catalog, files


@dataclass(frozen=True)
class SourceSpec:
    """How one canonical table is made from its raw files."""

    config: str
    raw: tuple[str, ...]                       # paths below raw/<family>/
    lon: str | None = None                     # None: found by known names or by prefix
    lat: str | None = None
    by_prefix: bool = False
    lower: bool = False                        # lower-case the source names
    point: str | None = None                   # column of POINT text holding the coordinates
    timestamp: str | None = None
    unit: str = "ms"
    splits: tuple[str, ...] = ()               # one constant split per raw file
    id: str | None = None
    siblings: tuple[str, ...] = ()             # files that complete missing coordinates by id
    raster: tuple[str, ...] = ()               # value columns sampled from raster tiles
    positive: bool = False                     # raster values of zero or less are missing
    checks: tuple[str, ...] = field(default=())  # value columns compared with the source


_USAVARS = tuple(f"usavars_{k}.csv" for k in catalog.USAVARS_LABELS)
SPECS: dict[str, list[SourceSpec]] = {
    "pdfm_conus27": [SourceSpec("pdfm_conus27", ("conus27.csv",), "longitude", "latitude")],
    "air_temp": [SourceSpec("air_temp", ("stationDataAll.csv",), by_prefix=True)],
    "california_housing": [SourceSpec("california_housing", ("california_housing.csv",), "Longitude", "Latitude", checks=("MedHouseVal",))],
    "satclip_official": [
        SourceSpec("satclip_country", ("lat_lon_country.csv",), "lon", "lat", checks=("country",)),
        SourceSpec("satclip_ecoregion", ("lat_lon_ecoregion.csv",), "lon", "lat", checks=("ecoregion_class_index", "biome_class_index")),
        SourceSpec("satclip_population", ("labels_population.csv",), "Lon", "Lat", checks=("log_population",)),
        SourceSpec("satclip_elevation", ("labels_elevation.csv",), "Lon", "Lat", checks=("elevation",)),
    ],
    "usavars": [SourceSpec(f"usavars_{k}", (f"usavars_{k}.csv",), lower=True, id="id", siblings=_USAVARS) for k in catalog.USAVARS_LABELS],
    "worldclim": [SourceSpec("worldclim_bio", (), "lon", "lat", raster=("bio1", "bio12"))],
    "soilgrids": [SourceSpec("soilgrids", (), "lon", "lat", raster=("soc", "phh2o"), positive=True)],
    "sustainbench": [SourceSpec("sustainbench", ("dhs_trainval_labels.csv", "dhs_test_labels.csv"), "lon", "lat", timestamp="year",
                                unit="year", splits=("trainval", "test"), id="DHSID_EA", checks=("asset_index",))],
    "cdc_places": [SourceSpec("cdc_places", ("cdc_places_zcta_2023.csv",), lower=True, point="geolocation")],
}


def shape(df: DataFrame, spec: SourceSpec, siblings: Sequence[DataFrame] = (), split: str | None = None) -> DataFrame:
    """One raw frame to canonical form by its spec."""
    d = clean.clean_names(df, lower=spec.lower)
    lon, lat = spec.lon, spec.lat
    if spec.point:
        x, y = clean.parse_point(spec.point)
        d, lon, lat = d.withColumn("lon", x).withColumn("lat", y), "lon", "lat"
    elif siblings and not {"lat", "lon"} <= set(d.columns):
        d, _ = clean.fill_coordinates(d, siblings, spec.id or "id")
        lon, lat = "lon", "lat"
    elif lon is None:
        lon, lat = clean.coordinate_names(d, by_prefix=spec.by_prefix)
    return clean.canonicalize(d, lon=lon, lat=lat, timestamp=spec.timestamp, unit=spec.unit, split_value=split,
                              id=spec.id if spec.id in d.columns else None)


def sample_table(points: DataFrame, rasters: dict[str, DataFrame], spec: SourceSpec, geometry: dict) -> DataFrame:
    """Raster values at the points, rows without every value dropped."""
    d = points
    for name in spec.raster:
        d = joins.sample_raster(d, rasters[name], out=name, **geometry)
        if spec.positive:
            d = d.withColumn(name, clean.nonpositive_to_null(name))
    return clean.canonicalize(d.dropna(subset=list(spec.raster)), lon="lon", lat="lat")


def normalize_family(spark: SparkSession, raw_root: str, out_root: str, family: str, *, points: DataFrame | None = None,
                     rasters: dict[str, DataFrame] | None = None, geometry: dict | None = None) -> list[str]:
    """Write every canonical table of a family; returns their configs."""
    if family == catalog.EVALUATION_FAMILY:
        found = files.discover(spark, f"{raw_root}/{family}").collect()  # file list
        for r in found:
            files.write_canonical(files.evaluation_table(spark, r["path"], r["stem"]), out_root, f"dm_{r['stem']}")
        return [f"dm_{r['stem']}" for r in found]
    if family not in SPECS:
        raise ValueError(f"unknown source family {family!r}")
    done = []
    for spec in SPECS[family]:
        if spec.raster:
            out = sample_table(points, rasters or {}, spec, geometry or {})
        else:
            read = lambda f: files.read_csv(spark, f"{raw_root}/{family}/{f}", lower=spec.lower)
            sib = []
            for f in spec.siblings:
                s = read(f)
                if {"id", "lat", "lon"} <= set(s.columns):
                    sib.append(s)
            parts = [shape(read(f), spec, sib, spec.splits[i] if spec.splits else None) for i, f in enumerate(spec.raw)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
        files.write_canonical(out, out_root, spec.config)
        done.append(spec.config)
    return done


def check_family(spark: SparkSession, raw_root: str, out_root: str, family: str) -> DataFrame:
    """Containment counts per checked column (config, column, coordinates, missing, bad)."""
    out = None
    for spec in SPECS[family]:
        target = files.read_canonical(spark, out_root, spec.config)
        for col in spec.checks:
            src = None
            for f in spec.raw:
                s = shape(files.read_csv(spark, f"{raw_root}/{family}/{f}", lower=spec.lower), spec).select("lon", "lat", col)
                src = s if src is None else src.unionByName(s)
            r = joins.containment(src, target, col, numeric=isinstance(target.schema[col].dataType, clean.NUMERIC))
            r = r.select(F.lit(spec.config).alias("config"), F.lit(col).alias("column"), "*")
            out = r if out is None else out.unionByName(r)
    if out is None:
        raise ValueError(f"family {family!r} lists no checked columns")
    return out


def build_training_points(cities: DataFrame, draws: DataFrame, tiles: DataFrame, out: str, *, years: Sequence[int], height: int,
                          width: int, tile: int, per_block: int, pixel, unpixel, teachers: dict[str, encoders.Weights],
                          seed: int = 0) -> tuple[str, str]:
    """Cities to boxes to blocks to valid pixels to shards, then the two curve-sorted tables.

    ``pixel(lat, lon)`` and ``unpixel(row, col)`` map between coordinates and the mosaic grid.
    Returns the paths of the teacher and annual tables.
    """
    spark = cities.sparkSession
    drawn = folds.weighted_draws(cities.withColumn("w", F.sqrt("population")), draws, id_col="city", weight="w", draw_col="draw", seed=seed)
    boxed = drawn.join(cities, "city").withColumn("box", geo.city_bbox("lat", "lon", "population"))
    blocks = folds.block_origins(boxed.select("draw", "box"), "draw", height=height, width=width, block_px=tile, box="box",
                                 chunk_px=tile, pixel=pixel, seed=seed).select("draw", "row0", "col0")
    px = folds.sample_blocks(blocks, tiles, per_block=per_block, years=len(years), key="draw", tile=tile, seed=seed)
    lon, lat = unpixel(F.col("row"), F.col("col"))
    files.write_shards(px.select(lat.alias("lat"), lon.alias("lon"), "targets"), f"{out}/shards", years)
    shards, manifest = files.read_shards(spark, f"{out}/shards")
    pts = files.number_shards(shards, manifest)
    pts = pts.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    vec = pts
    for name, w in teachers.items():
        vec = encoders.embed(vec, w, dim=None, out=name)
    files.write_points(vec, f"{out}/teachers", list(teachers))
    files.write_annual(pts, f"{out}/annual", years)
    return f"{out}/teachers", f"{out}/annual"
