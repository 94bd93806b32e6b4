"""Near-duplicate vectors by an epsilon grid order join, exact for a cosine threshold.

Unit vectors have cosine >= c exactly when their distance is at most eps = sqrt(2 - 2c). They are turned to their principal
axes; the leading coordinates, cut into cells of width eps, give the grid order. The sorted sequence is cut into
intervals, and two intervals meet only if their bounding boxes come within eps. Inside a task, two intervals are
joined recursively: halves whose boxes are farther apart than eps are skipped, small ones compared by a matrix product.
Pairs near the threshold are decided by the cosine of the given vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, components

#: Rows of an interval, of the smallest block, and principal axes in boxes and in the grid order.
INTERVAL, LEAF, BOX_AXES, GRID_AXES = 8192, 256, 16, 4
_SLACK = 1e-9


def _usable(vector: str):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest entry first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors (columns, leading first) of the second moments about the mean of all unit vectors."""
    def sums(batches):
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = unit_rows(_matrix(b.column(0)))
                n, s, m = n + len(u), s + u.sum(0), m + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([np.concatenate([s, m.ravel()])], pa.list_(pa.float64()))], ["i", "n", "x"])

    part = vectors.mapInArrow(sums, "i long, n long, x array<double>").select("n", F.posexplode("x").alias("at", "x"))
    got = part.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas().sort_values("at")  # dim * (dim + 1) numbers
    n = max(int(got["n"].iloc[0]), 1) if len(got) else 1
    x = got["x"].to_numpy() / n if len(got) else np.zeros(dim * (dim + 1))
    mean, second = x[:dim], x[dim:].reshape(dim, dim)
    values, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return axes[:, ::-1]


def _boxes_apart(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    """Whether the bounding boxes of the two sets of rows are farther apart than ``reach``."""
    gap = np.maximum(0.0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > reach * reach


def ordered_join(a: np.ndarray, b: np.ndarray, same: bool, eps: float, axes: int):
    """Index pairs (rows of a, rows of b) within about ``eps``, block by block; both sides in grid order.

    ``same``: a and b are one sequence, whose pairs p < q are wanted. Blocks have at most ``LEAF`` rows a side.
    """
    work = [(0, len(a), 0, len(b))] if len(a) and len(b) else []
    while work:
        i0, i1, j0, j1 = work.pop()
        if same and j1 <= i0 or _boxes_apart(a[i0:i1, :axes], b[j0:j1, :axes], eps):
            continue
        if max(i1 - i0, j1 - j0) <= LEAF:
            p, q = np.nonzero(a[i0:i1] @ b[j0:j1].T >= 1.0 - eps * eps / 2)
            p, q = p + i0, q + j0
            if same:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield p, q
            continue
        im = (i0 + i1) // 2 if i1 - i0 > LEAF else i1
        jm = (j0 + j1) // 2 if j1 - j0 > LEAF else j1
        work += [(*x, *y) for x in ((i0, im), (im, i1)) for y in ((j0, jm), (jm, j1)) if x[0] < x[1] and y[0] < y[1]]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the row of ``b``, in double precision; rescaled where squares leave the range."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        na, nb = (a * a).sum(1), (b * b).sum(1)
        c = (a * b).sum(1) / (np.sqrt(na) * np.sqrt(nb))
    odd = ~np.isfinite(c) | (np.minimum(na, nb) < 1e-290) | (np.maximum(na, nb) > 1e290)
    if odd.any():
        c[odd] = (unit_rows(a[odd]) * unit_rows(b[odd])).sum(1)
    return c


class Forest:
    """Union of row numbers, the least of each class as its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        """Joins the pairs of one block: labels settle among the block's rows first, so that few unions are left."""
        rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        x, y, label = at[:len(p)], at[len(p):], np.arange(len(rows))
        while True:
            least = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            if (new == label).all():
                break
            label = new
        for r, s in zip(rows.tolist(), rows[label].tolist()):
            if r != s:
                r, s = self.root(r), self.root(s)
                self.up[max(r, s)] = min(r, s)


def links(vectors: DataFrame, key: str, vector: str, cosine: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, edges): sid, m, rep of every usable row; linked rows by sid; edges that span the classes.

    Equal vectors share a representative (sid, with m copies), so that copies are never paired with each other. A task
    that joins two intervals counts the links of their rows and returns a spanning forest of them, not the pairs.
    """
    spark = vectors.sparkSession
    good = vectors.where(_usable(vector)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    widths = [r[0] for r in good.select(F.size("v")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    dim, eps = (widths or [1])[0], float(np.sqrt(2.0 - 2.0 * cosine)) + _SLACK
    kind = good.schema["v"].dataType.simpleString()
    good = good.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    reps = good.groupBy("h1", "h2", "v").agg(F.count("*").alias("m"), F.min("id").alias("rep")).withColumn("sid", F.monotonically_increasing_id())
    reps = cut_lineage(reps, "vectors")
    members = good.join(reps, ["h1", "h2", "v"]).select("id", "sid", "m", "rep")

    shared = spark.sparkContext.broadcast(principal_axes(reps.select("v"), dim))
    box, grid = min(BOX_AXES, dim), min(GRID_AXES, dim)

    def turned(col: pa.Array) -> np.ndarray:
        return unit_rows(_matrix(col)) @ shared.value if len(col) else np.zeros((0, dim))

    def place(b):
        t = turned(b.column(1))[:, :box]
        cells = np.floor(t[:, :grid] / eps).astype(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(list(t), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int64()))], ["sid", "v", "m", "t", "cell"])

    rows = arrow_map(reps.select("sid", "v", "m"), place, f"sid long, v {kind}, m long, t array<double>, cell array<long>")
    order = [F.col("cell"), *[F.col("t")[i] for i in range(grid)], F.col("sid")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    interval = F.shiftright("at", 33) * (1 << 20) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / INTERVAL)
    placed = cut_lineage(placed.withColumn("iv", interval), "grid")

    # intervals by the first-axis cells that they cover; neighbours share a cell or border on one
    bound = placed.groupBy("iv").agg(*[f(F.col("t")[i]).alias(f"{n}{i}") for i in range(box) for n, f in (("l", F.min), ("h", F.max))])
    bound = cut_lineage(bound, "boxes")
    cell = lambda c: F.floor(F.col(c) / eps)
    left = bound.select(F.explode(F.sequence(cell("l0") - 1, cell("h0") + 1)).alias("c"), *[F.col(c).alias(f"a_{c}") for c in bound.columns])
    right = bound.select(F.explode(F.sequence(cell("l0"), cell("h0"))).alias("c"), "*")
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a_l{i}") - F.col(f"h{i}"), F.col(f"l{i}") - F.col(f"a_h{i}")), 2) for i in range(box))
    meet = (left.join(right, "c").where((F.col("a_iv") <= F.col("iv")) & (gap <= eps * eps + 1e-6))
            .select(F.col("a_iv").alias("p"), F.col("iv").alias("q")).distinct())
    runs = placed.groupBy("iv").agg(F.sort_array(F.collect_list(F.struct("at", "sid", "m", "v"))).alias("rows"))  # at most INTERVAL rows each
    runs = cut_lineage(runs, "runs")
    task = (cut_lineage(meet, "meet").join(runs.select(F.col("iv").alias("p"), F.col("rows").alias("ra")), "p")
            .join(runs.select(F.col("iv").alias("q"), F.col("rows").alias("rb")), "q").select("p", "q", "ra", "rb"))

    def meet_rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, sides = batch.column(0)[k] == batch.column(1)[k], []
                for c in (2, 3):
                    r = batch.column(c)[k].values
                    f = dict(zip([x.name for x in r.type], r.flatten()))
                    t = turned(f["v"]).astype(np.float32)
                    sides.append((np.asarray(f["sid"]), np.asarray(f["m"]), _matrix(f["v"]), t))
                (sa, ma, va, ta), (sb, mb, vb, tb) = sides
                shift = 0 if same else len(sa)
                sid = sa if same else np.concatenate([sa, sb])
                count, forest = np.zeros(len(sid), np.int64), Forest(len(sid))
                # single precision finds candidates with some slack; the given vectors decide
                for p, q in ordered_join(ta, tb, same, float(np.sqrt(eps * eps + 1e-4)), box):
                    ok = cosines(va[p], vb[q]) >= cosine
                    p, q = p[ok], q[ok]
                    if len(p):
                        np.add.at(count, p, mb[q])
                        np.add.at(count, q + shift, ma[p])
                        forest.join(p, q + shift)
                hit = np.flatnonzero(count)
                root = np.array([forest.root(i) for i in hit.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(count[hit]), pa.array(sid[root] if len(hit) else sid[:0])], ["sid", "n", "root"])

    found = cut_lineage(task.repartition(parts, "p", "q").mapInArrow(meet_rows, "sid long, n long, root long"), "links")
    return members, found.groupBy("sid").agg(F.sum("n").alias("n")), found.where("sid != root").select("sid", "root")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite entries have no link and are kept. Rows with one key are vectors of
    their own in n_links, and one node in component_id. Vectors of different lengths raise an error.
    """
    members, sums, edges = links(vectors, key, vector, cosine)
    members = cut_lineage(members, "members")
    reps = members.groupBy("sid").agg(F.first("rep").alias("rep"))
    named = edges.join(reps.select("sid", F.col("rep").alias("a")), "sid").join(reps.select(F.col("sid").alias("root"), F.col("rep").alias("b")), "root").select("a", "b")
    copies = members.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    groups = components(named.union(copies), "vector_groups")
    linked = members.join(sums, "sid", "left").select("id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    linked = linked.join(groups, linked.id == groups.node, "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    rest = vectors.where(~F.coalesce(_usable(vector), F.lit(False))).select(F.col(key).alias("id"), F.lit(0).cast("long").alias("n"), F.col(key).alias("component_id"))
    return linked.union(rest).select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("component_id").cast("long").alias("component_id"),
                                     (F.col("id") == F.col("component_id")).alias("kept"))
