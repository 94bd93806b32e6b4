"""Exact nearest-neighbour joins on the sphere and in feature space.

Training rows are cut into leaves of similar size by a k-d split of a bounded sample; leaves that
turn out large are split again by place, on the executors, so no task ever holds an unbounded group. A query visits
one unit first, which bounds its k-th distance, then only the units whose boxes reach inside that
bound. Pairs never leave a task: each visit returns at most k candidates per query.

A query that few units can still serve goes to each of them. One that many can serve (in many dimensions boxes prune little) is not
copied to each: such queries form at most SWEEP_BLOCKS blocks that meet at most SWEEP_CHUNKS parts of the training rows, so that
what is shuffled grows with the rows and not with their pairs. Inside a meeting the boxes prune as before.

Identical coordinates are reduced first to their k lowest ids, which cannot change any top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import chord_to_km, km_to_chord, unit_xyz
from ..session import cut_lineage, spread
from .primitives import hash_uniform

LEAF_ROWS = 512        # aimed-at training rows per leaf
UNIT_ROWS = 4096       # a leaf above this is split again
BLOCK_ROWS = 4096      # query rows per task group
MAX_LEAVES = 65536     # cells of the first level, split on the driver
ROUTED = 1 << 18       # cells of a query by leaf matrix, and of a query by training row matrix
SHORT = 16             # units that a query is sent to one by one
SWEEP_BLOCKS, SWEEP_CHUNKS = 32, 16         # most blocks of the other queries, and most parts of the training rows they meet
SWEEP_QUERIES, SWEEP_ROWS = 16384, 16384    # rows of these as long as that gives no more of them
TILE_QUERIES, TILE_ROWS = 512, 512          # rows of a matrix inside a meeting
SAMPLE_PER_LEAF = 16   # bounds the sample the splits are chosen from


@dataclass
class LeafIndex:
    """Split tree plus, per leaf, the bounding box and the row count of every group."""

    axis: np.ndarray       # split dimension, -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray       # leaf number at a leaf node
    lo: np.ndarray         # [leaves, dims]
    hi: np.ndarray
    groups: np.ndarray     # sorted group codes
    counts: np.ndarray     # [leaves, groups]
    subs: np.ndarray       # sub-units per leaf
    residual: bool         # last dimension is the norm of the part outside the projection

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.axis[node] >= 0
            if not inner.any():
                return self.leaf[node]
            r = np.flatnonzero(inner)
            n = node[r]
            go_left = x[r, self.axis[n]] < self.cut[n]
            node[r] = np.where(go_left, self.left[n], self.right[n])

    def eligible(self, group, mode: str | None) -> np.ndarray:
        """Rows of each leaf that a query of ``group`` may use."""
        total = self.counts.sum(axis=1)
        if mode is None:
            return total
        j = np.searchsorted(self.groups, group)
        own = self.counts[:, j] if j < len(self.groups) and self.groups[j] == group else np.zeros_like(total)
        return total - own if mode == "other" else own

    def gap(self, lo: np.ndarray, hi: np.ndarray, leaves: np.ndarray | None = None) -> np.ndarray:
        """Smallest distance between the box (lo, hi) and each leaf box."""
        a, b = (self.lo, self.hi) if leaves is None else (self.lo[leaves], self.hi[leaves])
        d = np.maximum(0.0, np.maximum(a - hi, lo - b))
        return np.sqrt((d * d).sum(axis=1))

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Largest possible distance from each row of ``x`` to a row of each leaf, [rows, leaves]."""
        total = np.zeros((len(x), len(self.lo)))
        for j in range(x.shape[1]):
            if self.residual and j == x.shape[1] - 1:
                d = x[:, j, None] + self.hi[:, j]
            else:
                d = np.maximum(np.abs(x[:, j, None] - self.lo[:, j]), np.abs(self.hi[:, j] - x[:, j, None]))
            total += d * d
        return np.sqrt(total)

    def inside(self, x: np.ndarray, limit: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every box of ``leaves`` that a row of ``x`` reaches within its limit, by row."""
        total = np.zeros((len(x), len(leaves)))
        for j in range(x.shape[1]):
            d = np.maximum(0.0, np.maximum(self.lo[leaves, j] - x[:, j, None], x[:, j, None] - self.hi[leaves, j]))
            total += d * d
        row, at = np.nonzero(total <= (limit * limit)[:, None])
        return row, leaves[at]


def _split_tree(sample: np.ndarray, leaves: int):
    """Median splits along the widest dimension until ``leaves`` leaves exist."""
    axis, cut, left, right, leaf = [-1], [0.0], [-1], [-1], [-1]
    todo = [(0, np.arange(len(sample)), leaves)]
    n_leaf = 0
    while todo:
        node, rows, share = todo.pop()
        pts = sample[rows]
        span = pts.max(axis=0) - pts.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
        if share <= 1 or len(rows) < 2 or span.max() == 0:
            leaf[node] = n_leaf
            n_leaf += 1
            continue
        k = int(span.argmax())
        value = float(np.median(pts[:, k]))
        low = pts[:, k] < value
        if not low.any():
            value = float(np.nextafter(value, np.inf))
            low = pts[:, k] < value
        axis[node], cut[node] = k, value
        for child, mask, part in ((left, low, share // 2), (right, ~low, share - share // 2)):
            child[node] = len(axis)
            for arr, blank in ((axis, -1), (cut, 0.0), (left, -1), (right, -1), (leaf, -1)):
                arr.append(blank)
            todo.append((child[node], rows[mask], part))
    return tuple(np.array(a) for a in (axis, cut, left, right, leaf)) + (n_leaf,)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.concatenate(series.to_numpy()).astype("f8").reshape(len(series), -1) if len(series) else np.zeros((0, 1))


def _with_leaf(df: DataFrame, bc) -> DataFrame:
    @F.pandas_udf("int")
    def leaf_of(x: pd.Series) -> pd.Series:
        return pd.Series(bc.value.locate(_matrix(x)).astype("i4"))

    return df.withColumn("leaf", leaf_of("ix"))


def _grafted(tree: tuple, n_leaf: int, parts: list) -> tuple[tuple, int]:
    """The tree with a subtree in the place of some of its leaves; ``parts`` holds (leaf, axis, cut, left, right, leaf numbers)."""
    axis, cut, left, right, leaf = tree
    node_of = np.zeros(n_leaf, np.int64)
    node_of[leaf[axis < 0]] = np.flatnonzero(axis < 0)
    grown = [[a] for a in (axis, cut, left, right, leaf)]
    size = len(axis)
    for at, *sub in parts:
        s_axis, s_cut, s_left, s_right, s_leaf = (np.asarray(v) for v in sub)
        # node 0 of the subtree takes the leaf's node, leaf 0 its number; all others come after those there are
        moved = lambda child: np.where(child > 0, child + size - 1, child)
        numbers = np.where(s_leaf == 0, at, s_leaf + n_leaf - 1)
        values = (s_axis, s_cut, moved(s_left), moved(s_right), np.where(s_axis < 0, numbers, -1))
        for old, v in zip((axis, cut, left, right, leaf), values):
            old[node_of[at]] = v[0]
        for g, v in zip(grown, values):
            g.append(v[1:])
        size += len(s_axis) - 1
        n_leaf += int((s_axis < 0).sum()) - 1
    return tuple(np.concatenate(g) for g in grown), n_leaf


def _split_big(placed: DataFrame, big: DataFrame, leaf_rows: int, level: int) -> list:
    """Subtrees of the leaves in ``big`` (leaf, n), each split in a task of its own from a share of the leaf's rows."""
    def split(key, rows: pd.DataFrame) -> pd.DataFrame:
        want = -(-int(rows["n"].iloc[0]) // leaf_rows)
        axis, cut, left, right, leaf, _ = _split_tree(_matrix(rows["ix"]), want)
        return pd.DataFrame({"leaf": [key[0]], "axis": [axis], "cut": [cut], "left": [left], "right": [right], "numbers": [leaf]})

    share = float(SAMPLE_PER_LEAF) / leaf_rows
    few = placed.join(F.broadcast(big), "leaf").where(hash_uniform("tid", "grp", seed=21 + level) < share)  # at most MAX_LEAVES at first
    got = few.select("leaf", "n", "ix").groupBy("leaf").applyInPandas(
        split, "leaf int, axis array<int>, cut array<double>, left array<int>, right array<int>, numbers array<int>")
    return [tuple(r) for r in got.orderBy("leaf").collect() if len(r["axis"]) > 1]  # trees only


def _build_index(train: DataFrame, leaf_rows: int, residual: bool):
    """``train`` has ix, grp, tid. Cells are split on the driver from a bounded sample; cells that hold more than a unit are then split
    by place on the executors, as often as it takes. Rows that no split can part (one place in many groups) share a leaf whose units are cut by hash.
    """
    spark = train.sparkSession
    n = train.count()
    leaves = int(min(MAX_LEAVES, max(1, -(-n // leaf_rows))))
    want = leaves * SAMPLE_PER_LEAF
    take = train if n <= want else train.where(hash_uniform("tid", "grp", seed=11) < float(want) / n)
    sample = _matrix(take.select("ix").limit(2 * want).toPandas()["ix"]) if n else np.zeros((0, 1))
    *tree, n_leaf = _split_tree(sample, leaves)
    tree, dims, level = tuple(tree), sample.shape[1], 0
    blank = np.zeros((1, 1))
    draft = lambda: LeafIndex(*tree, blank, blank, np.zeros(0), blank, np.zeros(0), residual)
    aggs = [F.count(F.lit(1)).alias("n")]
    for j in range(dims):
        aggs += [F.min(F.col("ix")[j]).alias(f"lo{j}"), F.max(F.col("ix")[j]).alias(f"hi{j}")]
    while True:
        placed = _with_leaf(train, spark.sparkContext.broadcast(draft()))
        boxes = cut_lineage(placed.groupBy("leaf", "grp").agg(*aggs), "boxes") if n else None
        if not n:
            break
        span = F.greatest(*[F.max(f"hi{j}") - F.min(f"lo{j}") for j in range(dims)], F.lit(0.0))
        big = boxes.groupBy("leaf").agg(F.sum("n").alias("n"), span.alias("span")).where((F.col("n") > UNIT_ROWS) & (F.col("span") > 0)).select("leaf", "n")
        parts = _split_big(placed, big, leaf_rows, level) if big.limit(1).count() else []
        if not parts:
            break
        tree, n_leaf = _grafted(tree, n_leaf, parts)
        level += 1
    box = boxes.toPandas() if n else pd.DataFrame(columns=["leaf", "grp", "n"])
    groups = np.unique(box["grp"].to_numpy("i8")) if len(box) else np.zeros(0, "i8")
    counts = np.zeros((n_leaf, max(1, len(groups))), dtype=np.int64)
    lo, hi = np.full((n_leaf, dims), np.inf), np.full((n_leaf, dims), -np.inf)
    if len(box):
        at = box["leaf"].to_numpy("i8")
        np.add.at(counts, (at, np.searchsorted(groups, box["grp"].to_numpy("i8"))), box["n"].to_numpy("i8"))
        np.minimum.at(lo, at, box[[f"lo{j}" for j in range(dims)]].to_numpy("f8"))
        np.maximum.at(hi, at, box[[f"hi{j}" for j in range(dims)]].to_numpy("f8"))
    empty = counts.sum(axis=1) == 0
    lo[empty] = hi[empty] = 1e300  # never inside any bound
    subs = np.maximum(1, -(-counts.sum(axis=1) // UNIT_ROWS))
    index = LeafIndex(*tree, lo, hi, groups, counts, subs, residual)
    return index, spark.sparkContext.broadcast(index)


def _first_leaf(index: LeafIndex, x: np.ndarray, group: np.ndarray, k: int, mode, max_dist: float) -> np.ndarray:
    """Own leaf when it can fill the list, else the closest leaf that can, else the own leaf."""
    own = index.locate(x)
    out = own.copy()
    if np.isfinite(max_dist):
        return out  # the bound is already finite
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        ok = index.eligible(g, mode) >= k
        for lf in np.unique(own[rows]):
            if ok[lf] or not ok.any():
                continue
            d = np.where(ok, index.gap(index.lo[lf], index.hi[lf]), np.inf)
            out[rows[own[rows] == lf]] = int(d.argmin())
    return out


def _top(q: np.ndarray, qg: np.ndarray, t: np.ndarray, tg: np.ndarray, k: int, mode):
    """Row-wise k smallest distances; ties by position, which is id order. inf marks ineligible."""
    wide = q.shape[1] > 8
    idx_out, d_out = [], []
    step = max(1, ROUTED // max(1, len(t)))
    tn = (t * t).sum(axis=1)
    for s in range(0, len(q), step):
        a = q[s : s + step]
        if wide:
            d2 = (a * a).sum(axis=1)[:, None] + tn - 2.0 * (a @ t.T)
        else:
            d2 = np.zeros((len(a), len(t)))
            for j in range(q.shape[1]):
                diff = a[:, j, None] - t[None, :, j]
                d2 += diff * diff
        if mode is not None:
            same = qg[s : s + step, None] == tg[None, :]
            d2[same if mode == "other" else ~same] = np.inf
        kk = min(k, len(t))
        if len(t) > 4 * kk:
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
            slack = 1e-9 * (1.0 + tn.max()) if wide else 0.0
            with np.errstate(invalid="ignore"):
                m = int(min(len(t), max(kk, (d2 <= (kth + slack)[:, None]).sum(axis=1).max())))
            cand = np.sort(np.argpartition(d2, m - 1, axis=1)[:, :m], axis=1) if m < len(t) else (
                np.broadcast_to(np.arange(len(t)), d2.shape))
        else:
            cand = np.broadcast_to(np.arange(len(t)), d2.shape)
        dc = np.take_along_axis(d2, cand, axis=1)
        if wide:  # exact distances for the survivors only
            fin = np.isfinite(dc)
            few = max(1, ROUTED // max(1, cand.shape[1] * q.shape[1]))
            for u in range(0, len(a), few):
                diff = t[cand[u : u + few]] - a[u : u + few, None]
                dc[u : u + few] = np.where(fin[u : u + few], (diff * diff).sum(axis=2), np.inf)
        order = np.argsort(dc, axis=1, kind="stable")[:, :kk]
        idx_out.append(np.take_along_axis(cand, order, axis=1))
        d_out.append(np.sqrt(np.take_along_axis(dc, order, axis=1)))
    return np.concatenate(idx_out), np.concatenate(d_out)


def _within(q: np.ndarray, qg: np.ndarray, cap: np.ndarray, home: np.ndarray, t: np.ndarray, tn: np.ndarray, tg: np.ndarray, unit: np.ndarray,
            at: np.ndarray, k: int, mode):
    """(row of ``q``, row of ``t``, distance): for each query its k nearest rows among ``at`` (ascending) that lie within its cap and
    outside its first unit.

    Training rows come in tiles, and each tile lowers the caps; ties by position, as in ``_top``. ``tn`` has the squared norms of ``t``.
    """
    wide, limit, few = q.shape[1] > 8, cap.copy(), max(1, ROUTED // q.shape[1])
    row, pos, dist = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    qn, half = (q * q).sum(axis=1), -2.0 * q
    for s in range(0, len(at), TILE_ROWS):
        p = at[s:s + TILE_ROWS]
        u, slack = t[p], 0.0
        if wide:
            un = tn[p]
            d2 = half @ u.T
            d2 += un
            slack = 1e-9 * (1.0 + un.max() + qn.max()) - qn  # d2 lacks the query's norm
        else:
            d2 = np.zeros((len(q), len(u)))
            for j in range(q.shape[1]):
                diff = q[:, j, None] - u[None, :, j]
                d2 += diff * diff
        near = d2 <= (limit * limit * (1 + 1e-12) + slack)[:, None]
        r, c = np.divmod(np.flatnonzero(near), len(p))
        can = home[r] != unit[p[c]]
        if mode is not None:
            can &= (qg[r] != tg[p[c]]) if mode == "other" else (qg[r] == tg[p[c]])
        r, c = r[can], c[can]
        if not len(r):
            continue
        if wide:  # exact distances for the few that are near
            d = np.concatenate([((u[c[i:i + few]] - q[r[i:i + few]]) ** 2).sum(axis=1) for i in range(0, len(r), few)])
        else:
            d = d2[r, c]
        d = np.sqrt(d)
        ok = d <= limit[r]
        row, pos, dist = np.append(row, r[ok]), np.append(pos, p[c[ok]]), np.append(dist, d[ok])
        order = np.lexsort((pos, dist, row))
        row, pos, dist = row[order], pos[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        limit[row[last]] = np.minimum(limit[row[last]], dist[last])
        row, pos, dist = row[rank < k], pos[rank < k], dist[rank < k]
    return row, pos, dist


def _visit_schema(payload: T.StructType, qid_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid_type),
        T.StructField("grp", T.LongType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
        T.StructField("dist", T.ArrayType(T.DoubleType())),
        T.StructField("tid", T.ArrayType(T.LongType())),
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in payload],
        T.StructField("more", T.ArrayType(T.LongType())),
        T.StructField("many", T.BooleanType()),
        T.StructField("cap", T.DoubleType()),
        T.StructField("ix", T.ArrayType(T.DoubleType())),
        T.StructField("unit", T.LongType()),
    ])


def _cells(column) -> np.ndarray:
    """Arrow list column of equal lengths as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _lists(values, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def _onward(index: LeafIndex, ix: np.ndarray, group: np.ndarray, bound: np.ndarray, unit: int, k: int, mode, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Units, other than ``unit``, that may hold a row inside each query's bound: all units by query, their number per query. Those of a
    query that has more than ``most`` are only counted.

    Queries of a block meet the boxes near the whole block in matrices of at most ROUTED cells. ``bound`` is filled in place for queries
    without one: the distance that is sure to hold k rows.
    """
    number = np.zeros(len(ix), "i8")
    if not index.counts.any():  # no training rows at all
        return np.zeros(0, "i8"), number
    starts = np.concatenate([[0], np.cumsum(index.subs)])
    rows_out, units_out = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    home = np.searchsorted(starts, unit, "right") - 1  # the leaf that holds the unit
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        can = index.eligible(g, mode)
        free = rows[~np.isfinite(bound[rows])]
        for part in _slices(free, len(can)):
            far = index.reach(ix[part])
            order = np.argsort(far, axis=1)
            enough = np.cumsum(can[order], axis=1) >= k
            at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)[:, 0]
            bound[part] = np.where(enough.any(axis=1), far[np.arange(len(part)), at], np.inf)
        limit = bound[rows] * (1 + 1e-12)
        near = np.flatnonzero((can > 0) & (index.gap(ix[rows].min(axis=0), ix[rows].max(axis=0)) <= limit.max()))
        for at in _slices(np.arange(len(rows)), len(near)):
            row, leaf = index.inside(ix[rows[at]], limit[at], near)
            n = index.subs[leaf]
            to = np.bincount(row, n - (leaf == home), minlength=len(at))
            number[rows[at]] = to
            few = to[row] <= most
            row, leaf, n = row[few], leaf[few], n[few]
            first = np.cumsum(n) - n
            units_out.append(np.repeat(starts[leaf] - first, n) + np.arange(n.sum()))
            rows_out.append(np.repeat(rows[at][row], n))
    row, to = np.concatenate(rows_out), np.concatenate(units_out)
    row, to = row[to != unit], to[to != unit]
    return to[np.argsort(row, kind="stable")].astype("i8"), number


def _slices(rows: np.ndarray, width: int):
    """Parts of ``rows`` whose matrices with ``width`` columns stay below ROUTED cells."""
    step = max(1, ROUTED // max(1, width))
    for a in range(0, len(rows), step):
        yield rows[a:a + step]


def _visit_fn(bc, k: int, mode, max_dist: float, payload: list[str], route: bool, columns: list[str]):
    """Group function of one visit: (queries of a unit block, training rows of the unit) -> candidates."""

    def visit(queries: pa.Table, train: pa.Table) -> pa.Table:
        train = train.take(pc.sort_indices(train["tid"]))
        q, qg = _cells(queries["vec"]), queries["grp"].to_numpy()
        if len(train) and len(q):
            pos, dist = _top(q, qg, _cells(train["vec"]), train["grp"].to_numpy(), k, mode)
        else:
            pos, dist = np.zeros((len(q), 0), "i8"), np.zeros((len(q), 0))
        kth = dist[:, k - 1] if dist.shape[1] >= k else np.full(len(q), np.inf)
        bound = np.minimum(kth, max_dist)
        more, steps = np.zeros(0, "i8"), np.zeros(len(q), "i8")
        if route:
            if len(q):
                more, steps = _onward(bc.value, _cells(queries["ix"]), qg, bound, queries["unit"][0].as_py(), k, mode, SHORT)
                bound = np.minimum(np.where(np.isfinite(kth), bound, bound * (1 + 1e-12)), max_dist)  # that of whole boxes is rounded
        else:
            bound = np.minimum(bound, queries["cap"].to_numpy())
        keep = np.isfinite(dist) & (dist <= bound[:, None])
        sizes = keep.sum(axis=1)
        hits = train.take(pa.array(pos[keep]))
        out = {
            "qid": queries["qid"], "grp": queries["grp"], "vec": queries["vec"],
            "dist": _lists(dist[keep], sizes),
            "tid": _lists(hits["tid"].combine_chunks(), sizes),
            "more": _lists(more, np.where(steps > SHORT, 0, steps)), "many": pa.array(steps > SHORT), "cap": pa.array(bound), "unit": queries["unit"],
        }
        if route:
            out["ix"] = queries["ix"]
        for name in payload:
            out[name] = _lists(hits[name].combine_chunks(), sizes)
        return pa.table({c: out[c] for c in columns})

    return visit


def _sweep_fn(bc, k: int, mode, payload: list[str], columns: list[str]):
    """Group function of a meeting of many queries with many training rows: (queries, training rows) -> candidates.

    Queries go in the order of their first units, some hundred together, against the rows of the leaves that reach inside their caps.
    """
    def sweep(queries: pa.Table, train: pa.Table) -> pa.Table:
        train, queries = train.take(pc.sort_indices(train["tid"])), queries.take(pc.sort_indices(queries["unit"]))
        index, hits = bc.value, [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        if len(queries) and len(train):
            q, ix, t = _cells(queries["vec"]), _cells(queries["ix"]), _cells(train["vec"])
            qg, cap, home = (queries[c].to_numpy() for c in ("grp", "cap", "unit"))
            tg, unit = train["grp"].to_numpy(), train["unit"].to_numpy()
            starts = np.concatenate([[0], np.cumsum(index.subs)])
            leaves, leaf = np.unique(np.searchsorted(starts, unit, "right") - 1, return_inverse=True)
            tn = (t * t).sum(axis=1)
            for a in range(0, len(q), TILE_QUERIES):
                z = min(len(q), a + TILE_QUERIES)
                need = np.zeros(len(leaves), bool)
                for i in _slices(np.arange(a, z), len(leaves)):
                    need |= np.isin(leaves, index.inside(ix[i], cap[i] * (1 + 1e-12), leaves)[1])
                row, pos, dist = _within(q[a:z], qg[a:z], cap[a:z], home[a:z], t, tn, tg, unit, np.flatnonzero(need[leaf]), k, mode)
                hits.append((row + a, pos, dist))
        row, pos, dist = (np.concatenate(x) for x in zip(*hits))
        sizes, got = np.bincount(row, minlength=len(queries)), train.take(pa.array(pos))
        out = {"qid": queries["qid"], "dist": _lists(dist, sizes), "tid": _lists(got["tid"].combine_chunks(), sizes)}
        for name in payload:
            out[name] = _lists(got[name].combine_chunks(), sizes)
        return pa.table({c: out[c] for c in columns})

    return sweep


def _meetings(many: DataFrame, index: LeafIndex, mode) -> tuple[DataFrame, pd.DataFrame, np.ndarray] | None:
    """(queries with their block, meetings (side, block, chunk), chunk of every unit), or None without queries.

    Blocks follow the order of the units and chunks too, so both are compact; a meeting takes place where the box of a block, widened by its
    largest cap, reaches a leaf of the chunk with rows for it. A unit with many queries is spread over blocks by a draw. In mode "same" a block
    meets rows of its own group only (its side).
    """
    side = F.col("grp") if mode == "same" else F.lit(0).cast("long")
    many = many.withColumn("side", side)
    loads = many.groupBy("side", "unit").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["side", "unit"])  # one row a unit and group, as the boxes
    if not len(loads):
        return None
    n, spark = loads["n"].to_numpy("i8"), many.sparkSession
    size = max(SWEEP_QUERIES, -(-int(n.sum()) // SWEEP_BLOCKS))
    at = spark.createDataFrame(pd.DataFrame({"side": loads["side"].to_numpy("i8"), "unit": loads["unit"].to_numpy("i8"), "first": n.cumsum() - n, "load": n}),
                               "side long, unit long, first long, load long")
    draw = F.floor((F.col("first") + hash_uniform("qid", "grp", seed=31) * F.col("load")) / size).cast("int")
    many = many.join(at, ["side", "unit"]).withColumn("block", draw).drop("first", "load")
    dims = index.lo.shape[1]
    ends = [f(F.col("ix")[j]).alias(f"{name}{j}") for j in range(dims) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = many.groupBy("side", "block").agg(F.max("cap").alias("cap"), *ends).toPandas()  # at most SWEEP_BLOCKS and one more a group
    totals = index.counts.sum(axis=1)
    rows = index.counts.sum(axis=0).max() if mode == "same" else totals.sum()
    chunks = int(min(SWEEP_CHUNKS, max(1, -(-int(rows) // SWEEP_ROWS))))
    per_unit = np.repeat(totals / index.subs, index.subs)
    chunk = np.minimum((np.cumsum(per_unit) - per_unit) * chunks // max(1.0, totals.sum()), chunks - 1).astype("i8")
    leaf = np.repeat(np.arange(len(totals)), index.subs)
    met = []
    for r in boxes.itertuples():
        can = index.eligible(r.side, "same" if mode == "same" else None)
        lo, hi = (np.array([getattr(r, f"{e}{j}") for j in range(dims)]) for e in ("lo", "hi"))
        reached = (can > 0) & (index.gap(lo, hi) <= r.cap * (1 + 1e-12))
        met += [(int(r.side), int(r.block), int(c)) for c in np.unique(chunk[reached[leaf]])]
    return many, pd.DataFrame(met, columns=["side", "block", "chunk"]), chunk


def nearest(
    queries: DataFrame,
    train: DataFrame,
    *,
    k: int,
    mode: str | None = None,
    payload: tuple[str, ...] = (),
    max_dist: float = float("inf"),
    residual: bool = False,
    leaf_rows: int = LEAF_ROWS,
    lists: bool = False,
) -> DataFrame:
    """The ``k`` nearest training rows of every query: ``(qid, tid, dist, rank, *payload)``.

    ``queries``: qid, vec, ix, grp. ``train``: tid (bigint), vec, ix, grp and payload columns. ``vec``
    holds the coordinates distances are measured in, ``ix`` those the leaves are cut in (equal to
    ``vec``, or a projection of it followed by the norm of the remainder when ``residual``).
    ``mode``: None uses every row, "other" rows of another group, "same" rows of the same group.
    ``max_dist`` keeps distances up to it. Queries with no neighbour inside it give no rows. k is capped at the number of eligible rows.
    ``lists``: (qid, cand), cand an array of (dist, *payload) by rank, for queries with a qid of their own; a query that one visit
    serves is then not shuffled again.
    """
    fields = T.StructType([train.schema[p] for p in payload])
    dedupe = Window.partitionBy("vec", "grp").orderBy("tid")
    train = (
        train.select(*[F.col(c).alias(c) for c in ("tid", "vec", "ix", *payload)], F.col("grp").cast("long").alias("grp"))
        .withColumn("__r", F.row_number().over(dedupe)).where(F.col("__r") <= k).drop("__r")
    )
    # read by the count, the sample, the boxes and both visits: write the reduced rows once
    train = cut_lineage(train, "train")
    qid_type = queries.schema["qid"].dataType
    if isinstance(qid_type, T.StructType):  # every field nullable, as after a round trip
        qid_type = T.StructType([T.StructField(f.name, f.dataType) for f in qid_type])
    queries = queries.select(F.col("qid").cast(qid_type).alias("qid"), *[F.col(c).alias(c) for c in ("vec", "ix")],
                             F.col("grp").cast("long").alias("grp"))
    index, bc = _build_index(train, leaf_rows, residual)
    starts = np.concatenate([[0], np.cumsum(index.subs)]).astype("i8")
    subs_of = {int(i): int(index.subs[i]) for i in np.flatnonzero(index.subs > 1)}

    @F.pandas_udf("struct<leaf:int,unit:long>")
    def first_stop(x: pd.Series, g: pd.Series) -> pd.DataFrame:
        leaf = _first_leaf(bc.value, _matrix(x), g.to_numpy("i8"), k, mode, max_dist)
        return pd.DataFrame({"leaf": leaf.astype("i4"), "unit": starts[leaf]})

    @F.pandas_udf("long")
    def unit_of(x: pd.Series, draw: pd.Series) -> pd.Series:  # leaf and unit in one function: one Python worker a task
        lf = bc.value.locate(_matrix(x))
        n = np.array([subs_of.get(int(i), 1) for i in lf])
        return pd.Series(starts[lf] + np.minimum((draw.to_numpy() * n).astype("i8"), n - 1))

    placed = train.withColumn("unit", unit_of("ix", hash_uniform("tid", "grp", seed=5))).drop("ix")
    schema = _visit_schema(fields, qid_type)
    names = [f.name for f in schema]

    routed = queries.withColumn("__f", first_stop("ix", "grp")).select("qid", "vec", "ix", "grp", "__f.leaf", "__f.unit")
    routed = cut_lineage(routed, "routed")  # read for the unit loads and for the visit
    first = _co_visit(routed, placed, _visit_fn(bc, k, mode, max_dist, list(payload), True, names), schema)
    # Three readers follow (own candidates, unit loads, onward rows): write the visit once.
    cand, done = F.arrays_zip("dist", "tid", *payload), (F.size("more") == 0) & ~F.col("many")
    if lists:  # a list that is whole is put in order here and needs no ids any more
        whole = F.transform(F.sort_array(cand), lambda c: F.struct(c["dist"].alias("dist"), *[c[p].alias(p) for p in payload]))
        first = first.select("qid", "grp", "more", "many", "cap", "unit", F.when(F.col("many"), F.col("ix")).alias("ix"),
                             *[F.when(~done, F.col(c)).alias(c) for c in ("vec", "dist", "tid", *payload)], F.when(done, whole).alias("whole"))
    first = cut_lineage(first, "nearest")
    own = first.select("qid", cand.alias("cand"))
    # cap: kth distance so far, so that a later unit returns only candidates that can still matter
    onward = first.select("qid", "grp", "vec", "cap", F.explode("more").alias("unit"))
    shape = T.StructType([f for f in schema if f.name in ("qid", "dist", "tid", *payload)])
    later = _co_visit(onward, placed, _visit_fn(bc, k, mode, max_dist, list(payload), False, shape.names), shape)
    if lists:
        own = first.where(~done).select("qid", cand.alias("cand"))
    merged = own.unionByName(later.select("qid", cand.alias("cand")))
    met = _meetings(first.where("many").select("qid", "grp", "vec", "ix", "cap", "unit"), index, mode)
    if met is not None:
        many, pairs, chunk = met
        spark = train.sparkSession
        pairs = F.broadcast(spark.createDataFrame(pairs, "side long, block int, chunk int"))
        shared = spark.sparkContext.broadcast(chunk)

        @F.pandas_udf("int")
        def chunk_of(unit: pd.Series) -> pd.Series:
            return pd.Series(shared.value[unit.to_numpy("i8")].astype("i4"))

        side = F.col("grp") if mode == "same" else F.lit(0).cast("long")
        keys = ["side", "block", "chunk"]
        asked = spread(many.join(pairs, ["side", "block"]), *keys).groupBy(*keys)
        given = spread(placed.withColumn("side", side).withColumn("chunk", chunk_of("unit")).join(pairs, ["side", "chunk"]), *keys).groupBy(*keys)
        meet = _sweep_fn(bc, k, mode, list(payload), shape.names)
        swept = asked.cogroup(given).applyInArrow(lambda a, b: meet(a, b), shape)
        merged = merged.unionByName(swept.select("qid", cand.alias("cand")))
    best = merged.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("cand"))), 1, k).alias("cand"))
    if lists:
        kept = F.transform("cand", lambda c: F.struct(c["dist"].alias("dist"), *[c[p].alias(p) for p in payload]))
        return best.select("qid", kept.alias("cand")).unionByName(first.where(done).select("qid", F.col("whole").alias("cand"))).where(F.size("cand") > 0)
    return best.select("qid", F.posexplode("cand").alias("rank", "c")).select(
        "qid", "c.tid", "c.dist", (F.col("rank") + 1).alias("rank"), *[F.col(f"c.{p}") for p in payload]
    )


def _co_visit(queries: DataFrame, placed: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Meet queries and training rows at their unit, in blocks of bounded size on both sides."""
    loads = queries.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    q = queries.join(loads, "unit").withColumn("block", F.pmod(F.xxhash64("qid", "grp"), F.col("blocks")).cast("int"))
    t = placed.join(loads, "unit").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread(q.drop("blocks"), "unit", "block").groupBy("unit", "block").cogroup(
        spread(t.drop("blocks"), "unit", "block").groupBy("unit", "block")
    ).applyInArrow(lambda a, b: fn(a, b), schema)


# --------------------------------------------------------------------------- sphere

def _sphere(df: DataFrame, id_col: str, out_id: str, lat: str, lon: str, group: Column, extra=()) -> DataFrame:
    xyz = unit_xyz(lat, lon)
    return df.select(F.col(id_col).alias(out_id), xyz.alias("vec"), group.cast("long").alias("grp"), *extra).withColumn(
        "ix", F.col("vec")
    )


def sphere_knn(df: DataFrame, *, k: int, id_col: str = "id", fold: str = "fold", lat: str = "lat", lon: str = "lon",
               payload: tuple[str, ...] = (), **kw) -> DataFrame:
    """For each row its ``k`` nearest rows of the other folds: (qid, tid, km, rank, *payload)."""
    q = _sphere(df, id_col, "qid", lat, lon, F.col(fold))
    t = _sphere(df, id_col, "tid", lat, lon, F.col(fold), payload)
    hits = nearest(q, t, k=k, mode="other", payload=payload, **kw)
    return hits.withColumn("km", chord_to_km("dist")).drop("dist")


def sphere_lists(df: DataFrame, *, k: int, id_col: str = "id", fold: str = "fold", lat: str = "lat", lon: str = "lon", carry: tuple[str, ...] = (),
                 payload: tuple[str, ...] = (), **kw) -> DataFrame:
    """As ``sphere_knn``, one row per row that has neighbours: (id, fold, *carry, near), near an array of (km, *payload) by rank.

    ``carry`` goes along with the row, so that nothing is joined to it afterwards. Ids are unique.
    """
    q = _sphere(df.withColumn("qid", F.struct(id_col, fold, *carry)), "qid", "qid", lat, lon, F.col(fold))
    t = _sphere(df, id_col, "tid", lat, lon, F.col(fold), payload)
    hits = nearest(q, t, k=k, mode="other", payload=payload, lists=True, **kw)
    near = F.transform("cand", lambda c: F.struct(chord_to_km(c["dist"]).alias("km"), *[c[p].alias(p) for p in payload]))
    return hits.select("qid.*", near.alias("near"))


def nearest_train_km(df: DataFrame, *, id_col: str = "id", fold: str = "fold", lat: str = "lat", lon: str = "lon",
                     **kw) -> DataFrame:
    """(id, fold, km): distance from each held-out row to the closest row of the other folds."""
    hits = sphere_knn(df, k=1, id_col=id_col, fold=fold, lat=lat, lon=lon, **kw)
    return df.select(id_col, fold).join(hits.select(F.col("qid").alias(id_col), "km"), id_col, "left")


def held_out_km(df: DataFrame, folds: int, max_km: float, *, id_col: str = "id", fold: str = "fold",
                lat: str = "lat", lon: str = "lon", **kw) -> DataFrame:
    """(id, fold, km): for every training row of each held-out fold, the distance to that fold.

    Distances of ``max_km`` or more come back as null: one search serves every smaller radius.
    """
    others = df.withColumn("target", F.explode(F.array(*[F.lit(f) for f in range(folds)]))).where(
        F.col("target") != F.col(fold)
    )
    present = df.select(F.col(fold).alias("target")).distinct()
    others = others.join(F.broadcast(present), "target", "left_semi")  # at most ``folds`` rows
    q = _sphere(others.withColumn("qid", F.struct(id_col, "target")), "qid", "qid", lat, lon, F.col("target"))
    t = _sphere(df, id_col, "tid", lat, lon, F.col(fold))
    # compared in km below; the search radius is widened a little so that rounding cannot lose a pair
    hits = nearest(q, t, k=1, mode="same", max_dist=km_to_chord(max_km) * (1 + 1e-9) + 1e-12, **kw)
    km = hits.select(F.col(f"qid.{id_col}").alias(id_col), F.col("qid.target").alias("target"),
                     chord_to_km("dist").alias("km")).where(F.col("km") < max_km)
    return (
        others.select(id_col, "target").join(km, [id_col, "target"], "left")
        .select(id_col, F.col("target").alias(fold), "km")
    )


def buffer_flags(distances: DataFrame, radii: tuple[float, ...], fold: str = "fold") -> DataFrame:
    """One row per training row, fold and radius with ``kept``: dropped when strictly closer."""
    r = F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("radius_km")
    return distances.select("*", r).withColumn(
        "kept", F.col("km").isNull() | ~(F.col("km") < F.col("radius_km"))
    )
