"""Inverse-distance predictions of the same rows under many fold assignments, by one exact search.

Only folds differ between assignments, places do not. So the training rows are cut once into leaves (``neighbours``) and inside them into
cells of some ten rows. Boxes and fold counts of the cells are broadcast; from them alone follows which cells can hold a neighbour of some row
of a leaf under some assignment. A leaf's rows meet these cells in one task and leave it with their predictions: no candidate list is shuffled.

A leaf that needs more than MEET_ROWS training rows for an assignment (rows of other folds far away and all about as far) goes through
``neighbours.nearest`` instead, which is bounded for any layout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_KM, chord_to_km, unit_xyz
from ..session import cut_lineage, spread
from . import metrics
from . import neighbours as NB

LEAF_ROWS = 2048       # aimed-at training rows per leaf
CELL_ROWS = 64         # most training rows per cell as long as there are no more than MAX_CELLS, and queries handled together
MAX_CELLS = 1 << 18    # bounds the broadcast, about 200 bytes a cell
MEET_ROWS = 1 << 16    # most training rows that a leaf meets for one assignment, or MEET_CELLS cells where these are larger
MEET_CELLS = 64
FOLD_BITS = 3          # folds of all assignments are held in one long
MAX_GRIDS = 16         # assignments of one search
NEAREST_CELLS = 4096   # cells tried first for a leaf's bound
LIST_PER_K = 6         # rows of the list that all assignments share, in ks


@dataclass
class Cells:
    """Boxes and fold counts of all cells, by leaf; ``free`` and ``own`` are [cells, assignments x folds]."""

    leaf: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray
    free: np.ndarray     # rows of other folds, at most 255
    own: np.ndarray      # whether there is a row of the fold


def _cut(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and starts of cells of at most ``size`` rows: splits along the widest dimension."""
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
    while todo:
        a, z = todo.pop()
        parts = -(-(z - a) // size)
        if parts <= 1:
            starts.append(a)
            continue
        pts = x[order[a:z]]
        m = (z - a) * (parts // 2) // parts
        order[a:z] = order[a:z][np.argpartition(pts[:, (pts.max(axis=0) - pts.min(axis=0)).argmax()], m)]
        todo += [(a + m, z), (a, a + m)]
    return order, np.array(starts, "i8")


def _folds(grp: np.ndarray, grids: int) -> np.ndarray:
    """[assignments, rows] from the packed folds."""
    return np.stack([(grp >> (FOLD_BITS * c)) & ((1 << FOLD_BITS) - 1) for c in range(grids)]).astype("u1")


def _counts(folds: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """[cells, assignments, folds]: rows of every fold."""
    wide, cells = 1 << FOLD_BITS, len(starts)
    cell = np.repeat(np.arange(cells), np.diff(np.append(starts, n)))
    return np.stack([np.bincount(cell * wide + f, minlength=cells * wide).reshape(cells, wide) for f in folds], axis=1)


def _free(counts: np.ndarray) -> np.ndarray:
    """Rows of other folds, from the rows of every fold."""
    return counts.sum(axis=2, keepdims=True) - counts


def _spans(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distances between the box (lo, hi) and the boxes (a, z)."""
    gap = np.maximum(0.0, np.maximum(a - hi, lo - z))
    far = np.maximum(np.abs(z - lo), np.abs(hi - a))
    return np.sqrt((gap * gap).sum(axis=-1)), np.sqrt((far * far).sum(axis=-1))


def _pack_fn(size: int, grids: int):
    """Group function: the rows of a leaf as one row a cell."""
    def pack(rows: pa.Table) -> pa.Table:
        x = np.stack([rows[c].to_numpy() for c in "xyz"], axis=1)
        order, starts = _cut(x, size)
        x, grp = x[order], rows["grp"].to_numpy()[order]
        sizes = np.diff(np.append(starts, len(x)))
        counts = _counts(_folds(grp, grids), starts, len(x)).reshape(len(starts), -1)
        dims = np.full(len(starts), 3)
        return pa.table({
            "leaf": pa.array(np.full(len(starts), rows["leaf"][0].as_py(), "i4")), "cell": pa.array(np.arange(len(starts), dtype="i4")),
            "lo": NB._lists(np.minimum.reduceat(x, starts).ravel(), dims), "hi": NB._lists(np.maximum.reduceat(x, starts).ravel(), dims),
            "counts": NB._lists(counts.ravel().astype("i4"), np.full(len(starts), counts.shape[1])),
            "xyz": NB._lists(x.ravel(), 3 * sizes), "tid": NB._lists(rows["tid"].to_numpy()[order], sizes),
            "value": NB._lists(rows["value"].to_numpy()[order], sizes), "grp": NB._lists(grp, sizes)})

    return pack


def _load_cells(packed: DataFrame, grids: int) -> Cells:
    t = packed.select("leaf", "cell", "lo", "hi", "counts").toArrow()
    t = t.sort_by([("leaf", "ascending"), ("cell", "ascending")])
    counts = NB._cells(t["counts"]).reshape(len(t), grids, 1 << FOLD_BITS)
    flat = lambda a: a.reshape(len(t), grids << FOLD_BITS)
    return Cells(t["leaf"].to_numpy(), t["cell"].to_numpy(), NB._cells(t["lo"]), NB._cells(t["hi"]), counts[:, 0].sum(axis=1),
                 flat(np.minimum(_free(counts), 255).astype("u1")), flat(counts > 0))


def _bounds(free: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Per column the distance within which at least k rows surely lie; ``far`` ascends along the rows of ``free``."""
    enough = np.cumsum(free, axis=0, dtype="i8") >= k
    return np.where(enough[-1], far[enough.argmax(axis=0)], np.inf) if len(far) else np.full(free.shape[1], np.inf)


def _needed(cells: Cells, leaf: int, k: int, grids: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that can hold one of the k nearest rows of other folds of some row of ``leaf``: numbers, and [numbers, assignments] whether it is so there."""
    mine = np.arange(np.searchsorted(cells.leaf, leaf), np.searchsorted(cells.leaf, leaf, "right"))
    if not len(mine):
        return np.zeros(0, "i8"), np.zeros((0, grids), bool)
    cols = np.flatnonzero(cells.own[mine].any(axis=0))
    near, far = _spans(cells.lo[mine].min(axis=0), cells.hi[mine].max(axis=0), cells.lo, cells.hi)
    # the leaf as a whole first, from the nearest cells where these suffice
    some = np.argpartition(far, NEAREST_CELLS)[:NEAREST_CELLS] if len(far) > NEAREST_CELLS else np.arange(len(far))
    for pick in (some, np.arange(len(far))):
        pick = pick[np.argsort(far[pick])]
        limit = _bounds(cells.free[np.ix_(pick, cols)], far[pick], k)
        if np.isfinite(limit).all():
            break
    near_by = np.flatnonzero(near <= limit.max() * (1 + 1e-12))
    free = cells.free[np.ix_(near_by, cols)]
    can = ((near[near_by, None] <= limit * (1 + 1e-12)) & (free > 0)).any(axis=1)
    at, free = near_by[can], free[can]
    need, grid = np.zeros((len(at), grids), bool), cols >> FOLD_BITS
    for m in mine:
        near, far = _spans(cells.lo[m], cells.hi[m], cells.lo[at], cells.hi[at])
        here = np.flatnonzero(cells.own[m, cols])
        order = np.argsort(far)
        limit = _bounds(free[np.ix_(order, here)], far[order], k)
        hit = (near[:, None] <= limit * (1 + 1e-12)) & (free[:, here] > 0)
        need |= np.logical_or.reduceat(hit, np.searchsorted(grid[here], np.arange(grids)), axis=1) if len(at) else False
    return at, need


def _route_fn(bc, k: int, grids: int, most: int):
    """Leaf numbers -> (unit, leaf, cell, -1) for every cell the leaf meets, (unit, -1, -1, assignment) where these were too many."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bc.value
        for batch in batches:
            for leaf in batch.column(0).to_numpy():
                at, need = _needed(cells, int(leaf), k, grids)
                late = np.flatnonzero((need * cells.rows[at, None]).sum(axis=0) > most)
                need[:, late] = False
                at = at[need.any(axis=1)]
                none = np.full(len(late), -1)
                cols = (np.full(len(at) + len(late), leaf), np.append(cells.leaf[at], none), np.append(cells.cell[at], none), np.append(np.full(len(at), -1), late))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype("i4")) for c in cols], ["unit", "leaf", "cell", "grid"])

    return route


def _distances(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(x), t.shape[1]))
    for j in range(len(t)):
        diff = x[:, j, None] - t[j]
        diff *= diff
        d2 += diff
    return np.sqrt(d2, out=d2)


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k smallest of every row, ties by position."""
    k, n, row = min(k, d.shape[1]), d.shape[1], np.arange(len(d))[:, None]
    at = np.broadcast_to(np.arange(n), d.shape)
    if n > k:
        few = np.argpartition(d, k - 1, axis=1)[:, :k]
        most = int(np.count_nonzero(d <= d[row, few].max(axis=1)[:, None], axis=1).max())
        if most > k and most < n:  # ties at the end of some list
            few = np.argpartition(d, most - 1, axis=1)[:, :most]
        at = np.sort(few, axis=1) if most < n else at
    v = d[row, at]
    order = np.argsort(v, axis=1, kind="stable")[:, :k]
    return at[row, order], v[row, order]


def _meet_fn(ks: Sequence[int], grids: int, late: set, names: list[str]):
    """Group function: (rows of a leaf, the cells they need) -> (grid, fold, truth, a prediction for every k).

    Some ten queries go together. One list of their nearest rows, whatever the fold, serves every assignment under which it holds k rows of
    other folds; the queries for which it is too short get a list under that assignment.
    """
    k = max(ks)

    def meet(queries: pa.Table, train: pa.Table) -> pa.Table:
        grid, fold, truth, pred = np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0), np.zeros((0, len(ks)))
        if len(queries) and len(train):
            grid, at, rows, d, value = _meet(queries, train)
            fold, truth = _folds(queries["grp"].to_numpy(), grids)[grid, at], queries["truth"].to_numpy()[at]
            some = np.isfinite(d)
            km = 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.where(some, d, 0.0) / 2))
            w = np.where(some, 1.0 / np.maximum(km, metrics.WEIGHT_FLOOR_KM), 0.0)
            ends = np.array(ks) - 1
            pred = np.cumsum(w * value[rows], axis=1)[:, ends] / np.cumsum(w, axis=1)[:, ends]
        return pa.table(dict(zip(names, [grid.astype("i4"), fold.astype("i4"), truth, *pred.T])))

    def _meet(queries: pa.Table, train: pa.Table) -> tuple:
        """(assignment, query, its k nearest rows of other folds, their distances) for all that have such a row, and the rows' values.
        Lists with fewer rows end in rows at no finite distance."""
        unit = queries["unit"][0].as_py()
        asked = np.array([c for c in range(grids) if (unit, c) not in late], "i8")
        flat = lambda c: train[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        t, tid, value = flat("xyz").reshape(-1, 3), flat("tid"), flat("value")
        tf = _folds(flat("grp"), grids)
        sizes = train["tid"].combine_chunks().value_lengths().to_numpy()
        starts = np.cumsum(sizes) - sizes
        lo, hi = np.minimum.reduceat(t, starts), np.maximum.reduceat(t, starts)
        free = _free(_counts(tf, starts, len(t)))
        across = np.ascontiguousarray(t.T)
        q = np.stack([queries[c].to_numpy() for c in "xyz"], axis=1)
        qf = _folds(queries["grp"].to_numpy(), grids)

        def nearest(x: np.ndarray, n: int, e: np.ndarray, box: tuple, own: np.ndarray | None = None, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            """Rows and distances of the ``n`` nearest of every query, of other folds where ``own`` is given. ``e``: rows of every cell for each fold
            among the queries. ``box``: ends of a box that holds the queries, its smallest distances from the cells, cells by their largest ones."""
            a, z, near, by = box
            can = e.any(axis=1)
            first = by[can[by]]
            enough = (np.cumsum(e[first], axis=0) >= n).all(axis=1)
            bound = np.inf
            if enough.any():  # the n-th distances in the first cells that surely have n rows bound all others
                first = first[:enough.argmax() + 1]
                rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in first])
                d = _distances(x, across[:, rows])
                if own is not None:
                    np.putmask(d, own[:, None] == fold[rows], np.inf)
                bound = np.partition(d, n - 1, axis=1)[:, n - 1].max() * (1 + 1e-12)
            rows = np.flatnonzero(np.repeat(can & (near <= bound), sizes))
            one = own is not None and (own == own[0]).all()
            if one:
                rows = rows[fold[rows] != own[0]]
            if np.isfinite(bound):
                rows = rows[_spans(a, z, t[rows], t[rows])[0] <= bound]
            rows = rows[np.argsort(tid[rows], kind="stable")]
            d = _distances(x, across[:, rows])
            if own is not None and not one:
                np.putmask(d, own[:, None] == fold[rows], np.inf)
            pos, d = _first(d, n) if len(rows) else (np.zeros((len(x), 0), "i8"), d)
            return rows[pos], d

        out = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros((0, k), "i8"), np.zeros((0, k)))]
        order, cuts = _cut(q, CELL_ROWS)
        for a, z in zip(cuts, np.append(cuts[1:], len(q))):
            at = order[a:z]
            x = q[at]
            ends = x.min(axis=0), x.max(axis=0)
            near, far = _spans(*ends, lo, hi)
            box = *ends, near, np.argsort(far)
            rows, d = nearest(x, LIST_PER_K * k, sizes[:, None], box)
            other = tf[asked][:, rows] != qf[asked][:, at, None]
            rank = np.cumsum(other, axis=2, dtype="i4")
            served = rank[:, :, -1] >= k
            grid, i, pos = np.nonzero(other & (rank <= k) & served[:, :, None])  # k of each that is served, in order
            i, pos = i.reshape(-1, k), pos.reshape(-1, k)
            out.append((asked[grid[::k]], at[i[:, 0]], rows[i, pos], d[i, pos]))
            for j in np.flatnonzero(~served.all(axis=1)):
                c, left = asked[j], np.flatnonzero(~served[j])
                own = qf[c, at[left]]
                r, v = nearest(x[left], k, free[:, c, np.flatnonzero(np.bincount(own))], box, own, tf[c])
                if v.shape[1]:
                    some, short = np.isfinite(v[:, 0]), ((0, 0), (0, k - v.shape[1]))
                    out.append((np.full(some.sum(), c), at[left[some]], np.pad(r, short)[some], np.pad(v, short, constant_values=np.inf)[some]))
        return *(np.concatenate(c) for c in zip(*out)), value

    return meet


def idw_ladder(df: DataFrame, folds: Sequence[str], ks: Sequence[int], value: str, *, id_col: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(grid, fold, truth, p_<k>...): predictions of every row from its nearest rows of other folds, under each of the ``folds`` columns.

    ``grid`` is the position in ``folds``, whose values are 0 to 7. Equal distances go by id. Rows without a place are neither predicted nor
    used, rows without a neighbour have no prediction.
    """
    k, grids = max(ks), len(folds)
    if grids > MAX_GRIDS:
        first, rest = (idw_ladder(df, part, ks, value, id_col=id_col, lat=lat, lon=lon) for part in (folds[:MAX_GRIDS], folds[MAX_GRIDS:]))
        return first.unionByName(rest.withColumn("grid", F.col("grid") + MAX_GRIDS))
    spark, xyz = df.sparkSession, unit_xyz(lat, lon)
    packed_folds = sum([F.shiftleft(F.col(f).cast("long"), FOLD_BITS * c) for c, f in enumerate(folds)], F.lit(0).cast("long"))
    rows = df.select(F.col(id_col).cast("long").alias("tid"), *[xyz[j].alias(c) for j, c in enumerate("xyz")], F.col(value).cast("double").alias("value"),
                     packed_folds.alias("grp")).where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz"))
    rows = cut_lineage(rows, "rows")  # read by the count of equal places and by the queries
    same = Window.partitionBy("x", "y", "z", "grp").orderBy("tid", "value")
    train = cut_lineage(rows.withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= k).drop("__r"), "train")
    # boxes of the leaves are not used here, so one group will do
    index, tree = NB._build_index(train.select("tid", F.array("x", "y", "z").alias("ix"), F.lit(0).cast("long").alias("grp")), LEAF_ROWS, False)
    n = int(index.counts.sum())
    size = max(CELL_ROWS, -(-n // MAX_CELLS))
    placed = lambda d: NB._with_leaf(d.withColumn("ix", F.array("x", "y", "z")), tree).drop("ix")
    pack = _pack_fn(size, grids)
    cells = cut_lineage(spread(placed(train), "leaf").groupBy("leaf").applyInArrow(
        lambda t: pack(t), "leaf int, cell int, lo array<double>, hi array<double>, counts array<int>, xyz array<double>, tid array<long>, "
        "value array<double>, grp array<long>"), "cells")
    shared = spark.sparkContext.broadcast(_load_cells(cells, grids))
    most = max(MEET_ROWS, MEET_CELLS * size)
    parts = max(1, min(len(index.counts), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = cut_lineage(spark.range(0, len(index.counts), 1, parts).mapInArrow(_route_fn(shared, k, grids, most), "unit int, leaf int, cell int, grid int"), "met")
    late = {(r["unit"], r["grid"]) for r in met.where("grid >= 0").select("unit", "grid").collect()}  # at most leaves x assignments
    given = cells.select("leaf", "cell", "xyz", "tid", "value", "grp").join(met.where("grid < 0").drop("grid"), ["leaf", "cell"]).drop("leaf", "cell")
    asked = placed(rows).select(F.col("tid").alias("qid"), "grp", *"xyz", F.col("value").alias("truth"), F.col("leaf").alias("unit"))
    asked = cut_lineage(asked, "asked")  # read for the unit loads and for the meetings
    names = ["grid", "fold", "truth", *[f"p_{j}" for j in ks]]
    out = NB._co_visit(asked, given, _meet_fn(list(ks), grids, late, names), "grid int, fold int, truth double, " + ", ".join(f"p_{j} double" for j in ks))
    for c in sorted({c for _, c in late}):
        out = out.unionByName(_searched(asked.join(F.broadcast(met.where(F.col("grid") == c).select("unit")), "unit"), train, c, ks))
    return out


def _searched(asked: DataFrame, train: DataFrame, c: int, ks: Sequence[int]) -> DataFrame:
    """Predictions of some rows under assignment ``c`` by the general search."""
    fold, vec = F.shiftright("grp", FOLD_BITS * c).bitwiseAND((1 << FOLD_BITS) - 1), F.array("x", "y", "z")
    q = asked.select(F.struct(F.col("qid").alias("id"), fold.cast("int").alias("fold"), "truth", F.monotonically_increasing_id().alias("row")).alias("qid"),
                     vec.alias("vec"), vec.alias("ix"), fold.alias("grp"))
    t = train.select("tid", vec.alias("vec"), vec.alias("ix"), fold.alias("grp"), "value")
    hits = NB.nearest(q, t, k=max(ks), mode="other", payload=("value",), lists=True, leaf_rows=LEAF_ROWS)
    near = hits.select("qid.fold", "qid.truth", F.transform("cand", lambda x: F.struct(chord_to_km(x["dist"]).alias("km"), x["value"].alias("value"))).alias("near"))
    return near.select(F.lit(c).alias("grid"), "fold", "truth", *[metrics.idw_of(k, "value").alias(f"p_{k}") for k in ks])
