"""Fold assignment and sampling, all deterministic by seed and independent of partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import broadcast_if_bounded, cut_lineage
from .primitives import fixed_sample, hash_rank, hash_uniform, prefix_sum, ranked_in_buckets, value_rank

__all__ = ["fixed_sample"]  # re-exported next to the fold operators


def spatial_folds(df: DataFrame, *, folds: int = 5, cell_deg: float = 10.0, seed: int = 0, order: str = "hash",
                  lat: str = "lat", lon: str = "lon", out: str = "fold") -> DataFrame:
    """Whole grid cells go to one fold; cells per fold differ by at most one.

    ``order="hash"`` shuffles the cells by seed, ``order="lex"`` takes them row by row. Only the
    distinct cells are ranked. Their number is bounded by the cell size, which decides the join. Rows with a missing or
    NaN coordinate share one cell of their own, the last in the row by row order.
    """
    side = cell_folds(df, [cell_deg], folds=folds, seed=seed, order=order, lat=lat, lon=lon, out=out).drop("__at")
    return with_cells(df, cell_deg, lat=lat, lon=lon).join(bounded_cells(side, cell_deg), ["__cla", "__clo"]).drop("__cla", "__clo")


def _cell(lat: str, lon: str, cell_deg: float) -> list[Column]:
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return [F.when(known, c).otherwise(F.lit(1 << 40)).alias(name) for c, name in zip(geo.grid_cell(lat, lon, cell_deg), ("__cla", "__clo"))]


def with_cells(df: DataFrame, cell_deg: float, *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Grid cell of every row, as __cla and __clo."""
    return df.select("*", *_cell(lat, lon, cell_deg))


def cell_folds(df: DataFrame, cells: Sequence[float], *, folds: int = 5, seed: int = 0, order: str = "hash", lat: str = "lat", lon: str = "lon",
               out: str = "fold") -> DataFrame:
    """(__at, __cla, __clo, fold) of the grid cells that hold rows, to be joined to ``with_cells``; __at is the position in ``cells``."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__at"), *_cell(lat, lon, c)) for i, c in enumerate(cells)])).alias("__c")
    found = df.select(each).select("__c.*").distinct()
    if order == "hash":
        ranked = hash_rank(found, ["__cla", "__clo"], group=["__at"], seed=seed, stream=3, out="__r")
    elif order == "lex":
        # a grid row holds at most 360 / cell_deg cells, so rows serve as buckets without any sampling
        ranked = ranked_in_buckets(found, ["__at"], ["__cla"], [F.col("__clo")], "__r")
    else:
        raise ValueError(f"unknown cell order {order!r}")
    return ranked.select("__at", "__cla", "__clo", (F.col("__r") % folds).cast("int").alias(out))


def bounded_cells(side: DataFrame, cell_deg: float) -> DataFrame:
    """The cells of one size, broadcast where their greatest number allows it."""
    return broadcast_if_bounded(side, int((180.0 / cell_deg + 2) * (360.0 / cell_deg + 2)) + 1)


def random_folds(df: DataFrame, id_col: str, *, folds: int = 5, seed: int = 0, stream: int = 4, group=(),
                 out: str = "fold") -> DataFrame:
    """Fold sizes equal to within one, per ``group`` when given."""
    return (
        hash_rank(df, [id_col], group=group, seed=seed, stream=stream, out="__r")
        .withColumn(out, (F.col("__r") % folds).cast("int")).drop("__r")
    )


def modulo_folds(df: DataFrame, id_col: str, *, folds: int = 5, out: str = "fold") -> DataFrame:
    """Row position in id order, modulo the fold count."""
    return (
        value_rank(df, id_col, id_col, out="__r").withColumn(out, (F.col("__r") % folds).cast("int")).drop("__r")
    )


def stratified_folds(df: DataFrame, id_col: str, label: str, *, folds: int = 5, seed: int = 0, out: str = "fold"):
    """Class shares equal to within one row in every fold."""
    return random_folds(df, id_col, folds=folds, seed=seed, stream=5, group=[label], out=out)


def inner_buckets(df: DataFrame, id_col: str, *, buckets: int = 5, seed: int = 0, fold: str = "fold",
                  out: str = "bucket") -> DataFrame:
    """Random inner folds for nested selection: one bucket per row, balanced inside each outer fold.

    The inner split of outer fold f tests bucket b of the rows outside f, so one column serves all f.
    """
    return random_folds(df, id_col, folds=buckets, seed=seed, stream=6, group=[fold], out=out)


def matched_deletion(df: DataFrame, removed: DataFrame, id_col: str, *, keys: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Random control for a deletion: per key drop as many rows as ``removed`` says (column n_removed).

    Keys are ranked by hash, so the kept set for a smaller count contains that for a larger one.
    """
    ranked = hash_rank(df, [id_col], group=list(keys), seed=seed, stream=8, out="__r")
    return (
        ranked.join(removed, list(keys), "left")
        .withColumn("kept", F.col("__r") >= F.coalesce(F.col("n_removed"), F.lit(0))).drop("__r", "n_removed")
    )


def sphere_points(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """One uniform point on the sphere per row: adds lat, lon."""
    u = hash_uniform(*keys, seed=seed, stream=20)
    v = hash_uniform(*keys, seed=seed, stream=21)
    return df.withColumn("lat", F.degrees(F.asin(2 * u - 1))).withColumn("lon", 360.0 * v - 180.0)


def weighted_draws(df: DataFrame, draws: DataFrame, *, id_col: str, weight: str, draw_col: str, seed: int = 0) -> DataFrame:
    """Draws with replacement, probability proportional to ``weight``: (draw_col, id_col).

    Distributed prefix sums lay the rows out on [0, total); a draw takes the row whose interval it
    falls in. Both sides meet in value buckets of equal width, so a heavy row covers many buckets
    (one copy in each) and no bucket holds more than its share of the draws.
    """
    cum = prefix_sum(df.select(id_col, weight).where(F.col(weight) > 0), id_col, weight, out="__hi")
    total, n = cum.agg(F.max("__hi"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("weights must have a positive sum")
    width = float(total) / max(1, n)
    span = cum.withColumn("__lo", F.col("__hi") - F.col(weight)).withColumn(
        "__cell", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width)))
    )
    d = draws.select(draw_col).withColumn("__u", hash_uniform(draw_col, seed=seed, stream=30) * float(total))
    d = d.withColumn("__cell", F.floor(F.col("__u") / width))
    hit = d.join(span, "__cell").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    # rounding in the running sums can leave hairline overlaps: keep the lowest id
    return hit.groupBy(draw_col).agg(F.min(id_col).alias(id_col))


def block_origins(df: DataFrame, *keys: str, height: int, width: int, block_px: int = geo.MOSAIC_CHUNK_PX,
                  box: str | None = None, snap: bool = True, chunk_px: int = geo.MOSAIC_CHUNK_PX,
                  pixel=geo.lonlat_to_pixel, seed: int = 0) -> DataFrame:
    """Block origin (row0, col0) per row: inside the row's ``box`` struct, or uniform over the array."""
    u = hash_uniform(*keys, seed=seed, stream=40)
    v = hash_uniform(*keys, seed=seed, stream=41)
    if box:
        b = F.col(box)
        r, c = pixel(b["south"] + u * (b["north"] - b["south"]), b["west"] + v * (b["east"] - b["west"]))
        clamp = lambda x, hi: F.greatest(F.lit(0), F.least(F.lit(hi - block_px), x.cast("long")))
        row0, col0 = clamp(r, height), clamp(c, width)
    else:
        row0, col0 = F.floor(u * (height - block_px)), F.floor(v * (width - block_px))
    if snap:
        row0, col0 = F.floor(row0 / chunk_px) * chunk_px, F.floor(col0 / chunk_px) * chunk_px
    return df.withColumn("row0", row0.cast("long")).withColumn("col0", col0.cast("long"))


def sample_blocks(blocks: DataFrame, tiles: DataFrame, *, per_block: int, years: int, key: str, tile: int, seed: int = 0) -> DataFrame:
    """Up to ``per_block`` pixels per tile-aligned block that are valid in every year and band.

    Returns key, row, col, targets (array over years, in year order). Validity is reduced to pixel
    positions per tile before anything is joined, so vectors move only for the chosen pixels.
    """
    bad = lambda px: F.exists(px, lambda v: v.isNull() | (v == -128))
    positions = F.filter(F.sequence(F.lit(0), F.size("pixels") - 1), lambda i: ~bad(F.get(F.col("pixels"), i)))
    valid = tiles.select("tile_row", "tile_col", positions.alias("p")).groupBy("tile_row", "tile_col").agg(
        F.collect_list("p").alias("ps")).where(F.size("ps") == years)  # one list per year, each at most one tile long
    valid = valid.select("tile_row", "tile_col", F.aggregate(
        F.slice("ps", F.lit(2), F.size("ps")), F.col("ps")[0], lambda acc, p: F.array_intersect(acc, p)).alias("ok"))
    b = blocks.withColumn("tile_row", F.floor(F.col("row0") / tile).cast("long")).withColumn("tile_col", F.floor(F.col("col0") / tile).cast("long"))
    picked = b.join(valid, ["tile_row", "tile_col"]).select(key, "tile_row", "tile_col", F.slice(F.sort_array(F.transform(
        "ok", lambda i: F.struct(F.xxhash64(F.col(key), i, F.lit(seed)).alias("h"), i.alias("i")))), 1, per_block).alias("pick"))
    got = picked.join(tiles, ["tile_row", "tile_col"]).select(
        key, "tile_row", "tile_col", "year", F.transform("pick", lambda s: F.struct(
            s["i"].alias("i"), F.get(F.col("pixels"), s["i"]).alias("v"))).alias("hit"))
    long = got.select(key, "tile_row", "tile_col", "year", F.explode("hit").alias("h"))
    return long.groupBy(key, "tile_row", "tile_col", F.col("h.i").alias("i")).agg(
        F.sort_array(F.collect_list(F.struct("year", F.col("h.v").alias("v")))).alias("t")).select(
        key, (F.col("tile_row") * tile + F.floor(F.col("i") / tile)).cast("long").alias("row"),
        (F.col("tile_col") * tile + F.col("i") % tile).cast("long").alias("col"), F.transform("t", lambda x: x["v"]).alias("targets"))


def first_on_land(df: DataFrame, key: str, polygons: DataFrame, draw, tries: int, first_stage: int = 3) -> DataFrame:
    """(key, attempt, lat, lon): the first of up to ``tries`` draws on land, for the rows that get one.

    ``draw(attempt)`` gives (lat, lon) columns. A short first stage settles most rows; only the rest
    is expanded to the remaining attempts.
    """
    from .joins import point_in_polygon

    def stage(rows: DataFrame, lo: int, hi: int) -> DataFrame:
        a = rows.withColumn("attempt", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        la, lo_ = draw(F.col("attempt"))
        moved = a.select(key, "attempt", la.alias("lat"), lo_.alias("lon"))
        # a draw inside several polygons comes several times, which the minimum does not see
        best = point_in_polygon(moved, polygons).groupBy(key).agg(F.min(F.struct("attempt", "lat", "lon")).alias("b"))
        return best.select(key, "b.attempt", "b.lat", "b.lon")

    one = stage(df, 1, min(first_stage, tries))
    if tries <= first_stage:
        return one
    one = cut_lineage(one, "first_stage")
    return one.unionByName(stage(df.join(one.select(key), key, "left_anti"), first_stage + 1, tries))


def land_anchors(ids: DataFrame, key: str, polygons: DataFrame, *, lat_min: float = -56.0, lat_max: float = 70.0, seed: int = 0,
                 tries: int = 64) -> DataFrame:
    """One area-weighted land point per id: latitudes uniform in their sine, redrawn until on land.

    Ids without a hit in ``tries`` draws go through further rounds, each of twice as many draws up to 65 536, so none is lost. An
    empty mask raises, as does one that no id hits in ten rounds running (it lies outside the band, or is too small).
    """
    if not polygons.limit(1).count():
        raise ValueError("no land polygon")
    lo, hi = math.sin(math.radians(lat_min)), math.sin(math.radians(lat_max))

    def draw(attempt):
        u = hash_uniform(key, attempt, seed=seed, stream=50)
        v = hash_uniform(key, attempt, seed=seed, stream=51)
        return F.degrees(F.asin(F.lit(lo) + u * (hi - lo))), v * 360.0 - 180.0

    left, found, done, idle = ids.select(key).distinct(), None, 0, 0
    while idle < 10:
        got = first_on_land(left, key, polygons, lambda a, k=done: draw(a + F.lit(k)), tries, first_stage=4)
        got = cut_lineage(got.withColumn("attempt", F.col("attempt") + F.lit(done)), "anchors")
        found = got if found is None else found.unionByName(got)
        rest = cut_lineage(left.join(got, key, "left_anti"), "anchors_left")
        n, done, tries = rest.count(), done + tries, min(2 * tries, 1 << 16)
        if not n:
            return found
        idle = 0 if got.limit(1).count() else idle + 1
        left = rest
    raise ValueError(f"{n} ids found no land")


def land_offsets(pairs: DataFrame, key: str, polygons: DataFrame, *, km: str = "lag_km", seed: int = 0, tries: int = 25) -> DataFrame:
    """(key, attempt, lat, lon): each anchor moved ``km`` along the first bearing that ends on land."""
    def draw(attempt):
        brg = hash_uniform(key, attempt, seed=seed, stream=52) * F.lit(2 * math.pi)
        return geo.geodesic_offset("lat", "lon", F.col(km), brg)

    return first_on_land(pairs, key, polygons, draw, tries)
