"""Embedding whitening by bit-sliced scatter: exact integer cross-products from AND-popcounts of packed bit planes.

Vectors become integers; the fit list holds each distinct one once. Per dimension the values less the dimension's minimum are cut
into bit planes, each plane is packed across rows into 64-bit words, and the cross-product of two dimensions is the sum of
2^(a + b) times the popcount of plane a AND plane b. A constant dimension of ones gives the row count and the sums in the same
way. Counts are added over tasks without rounding and centred as integers, n * C - S * S', before the eigendecomposition.

Vectors of different lengths are different spaces: each length has its own fit list, model and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of a sum of counts that share a double. A sum stays below 2^53, so exact, up to 2^39 vectors.
LIMB = 8
#: Rows whose planes are held at once.
ROWS = 8192
#: Components with an eigenvalue below this share of the trace count as absent.
LEAST = 1e-13


@dataclass(frozen=True)
class Model:
    """Fit of one vector length: row count, integer sums, eigenvalues (falling), unit eigenvectors as columns, and trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    covariance: np.ndarray


def present(vec: str) -> Column:
    """True for a vector without null, NaN or infinite entries."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(F.col(vec).cast("array<double>"), fine), F.lit(False))


def integers(vec: str, scale: int = 256) -> Column:
    """floor(scale * c) of every entry as long; beyond the range of long the nearest long."""
    return F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))


def plane_counts(u: np.ndarray, bits: int) -> np.ndarray:
    """(i, j, s): popcounts of plane a of column i AND plane b of column j, added over a + b = s, for j >= i.

    ``u`` is a matrix of unsigned integers below 2^bits.
    """
    n, d = u.shape
    words = -(-n // 64)
    planes = np.zeros((d, bits, words), np.uint64)
    for a in range(bits):
        packed = np.zeros((d, 8 * words), np.uint8)
        packed[:, :-(-n // 8)] = np.packbits(((u >> np.uint64(a)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        planes[:, a] = packed.view(np.uint64)
    out = np.zeros((d, d, 2 * bits - 1), np.int64)
    for i in range(d):
        for a in range(bits):
            if planes[i, a].any():
                out[i, i:, a:a + bits] += np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64)
    return out


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)


def _by_width(batch: pa.RecordBatch, at: int, widths) -> Iterator[tuple[int, np.ndarray]]:
    """(width, row numbers) of the batch for the widths asked for."""
    size = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(size[size > 0]).tolist():
        if w in widths:
            yield w, np.flatnonzero(size == w)


def scatter(fit: DataFrame, lows: dict[int, np.ndarray], bits: dict[int, int], vec: str = "x") -> DataFrame:
    """Exact cross-products of [1, x - low] as (width, i, limbs), added over all rows; ``fit`` holds long arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for w, rows in _by_width(b, 0, lows):
                for k in range(0, len(rows), ROWS):
                    x = _matrix(b.column(0).take(pa.array(rows[k:k + ROWS])), w)
                    u = np.ones((len(x), w + 1), np.uint64)
                    u[:, 1:] = x.astype(np.uint64) - lows[w].astype(np.uint64)  # the difference is right modulo 2^64
                    c = plane_counts(u, bits[w])
                    held[w] = held[w] + c if w in held else c
        for w, c in held.items():
            s = c.shape[2]
            limbs = np.stack([(c[:, :, g:g + LIMB] << np.arange(min(LIMB, s - g))).sum(2) for g in range(0, s, LIMB)], 2).astype(np.float64)
            for i in range(len(limbs)):
                cells = pa.array(limbs[i, i:].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([i], pa.int32()), pa.ListArray.from_arrays(
                    pa.array([0, len(cells)], pa.int32()), cells)], ["width", "i", "limbs"])

    part = fit.select(vec).mapInArrow(run, "width int, i int, limbs array<double>")
    return part.groupBy("width", "i").agg(Summarizer.sum(array_to_vector("limbs")).alias("s")).select("width", "i", vector_to_array("s").alias("limbs"))


def _solve(rows: list, low: np.ndarray, bits: int, components: int) -> Model:
    """The model of one length from its (i, limbs) rows."""
    d, limbs = len(low) + 1, -(-(2 * bits - 1) // LIMB)
    c = np.zeros((d, d), object)
    for i, cells in rows:
        parts = np.asarray(cells).reshape(d - i, limbs)
        c[i, i:] = c[i:, i] = [sum(int(v) << (LIMB * g) for g, v in enumerate(p)) for p in parts]
    n = c[0, 0]
    centred = n * c[1:, 1:] - np.outer(c[0, 1:], c[0, 1:])
    cov = (centred / (n * n)).astype(np.float64)
    e, q = np.linalg.eigh(cov)
    e, q, trace = e[::-1], q[:, ::-1], sum(centred.diagonal().tolist()) / (n * n)
    keep = int((e[:components] > LEAST * trace).sum()) if trace > 0 else 0
    sums = tuple(s + n * int(m) for s, m in zip(c[0, 1:], low))
    return Model(n, sums, e[:keep], np.ascontiguousarray(q[:, :keep]), trace, cov)


def learn(fit: DataFrame, vec: str = "x", components: int = 4) -> dict[int, Model]:
    """A model for each vector length of ``fit``, which holds each distinct integer vector once.

    The driver gets one matrix a length (no rows of the table). An empty list gives no models; empty vectors have none.
    """
    ranges = fit.select(F.size(vec).alias("w"), F.posexplode(vec).alias("dim", "x")).groupBy("w", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lows, highs = {}, {}
    for r in ranges.collect():  # one row a length and dimension
        lows.setdefault(r["w"], np.zeros(r["w"], np.int64))[r["dim"]] = r["lo"]
        highs.setdefault(r["w"], np.zeros(r["w"], np.int64))[r["dim"]] = r["hi"]
    bits = {w: max(1, *(int(h - l).bit_length() for h, l in zip(highs[w].tolist(), lows[w].tolist()))) for w in lows}
    got: dict[int, list] = {}
    for r in scatter(fit, lows, bits, vec).collect():  # one matrix a length
        got.setdefault(r["width"], []).append((r["i"], r["limbs"]))
    return {w: _solve(rows, lows[w], bits[w], components) for w, rows in got.items()}


def _whitened(x: np.ndarray, m: Model) -> tuple[np.ndarray, list]:
    """Projections over the roots of the eigenvalues, and the exact squared distances n * x - S (None beyond long)."""
    top = m.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in m.sums) if len(x) else 0
    if x.shape[1] * top * top < 1 << 63:
        z = m.n * x - np.array(m.sums, np.int64)
        far = (z * z).sum(1).tolist()
    else:
        z = m.n * x.astype(object) - np.array(m.sums, object)
        far = [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]
    return (z / m.n).astype(np.float64) @ (m.vectors / np.sqrt(m.values)), far


def apply(df: DataFrame, models: dict[int, Model], vec: str = "x", out: tuple[str, str] = ("whitened", "deviation")) -> DataFrame:
    """``df`` with the whitened components (array<double>) and the squared deviation (long) of integer vectors ``vec``.

    The deviation is the sum over dimensions of (n * x - S)^2, exact, null where it exceeds a long. Vectors of a length without a
    model get nulls. Fewer components than asked for come where the covariance has a lower rank (none for a single distinct
    vector). Existing columns with the names of ``out`` are replaced (``vec`` must not be one of them).
    """
    rest = [c for c in df.columns if c not in out]
    at = rest.index(vec)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        known = shared.value
        for b in batches:
            made, far = np.full(b.num_rows, None, object), [None] * b.num_rows
            for w, rows in _by_width(b, at, known):
                y, f = _whitened(_matrix(b.column(at).take(pa.array(rows)), w), known[w])
                for k, r in enumerate(rows.tolist()):
                    made[r], far[r] = y[k], f[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64())), pa.array(far, pa.int64())], [*rest, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    return df.select(*rest).mapInArrow(run, f"{schema}, `{out[0]}` array<double>, `{out[1]}` long")


def identity_errors(fit: DataFrame, models: dict[int, Model], vec: str = "x") -> dict[int, float]:
    """Per length the largest absolute entry of the covariance of the whitened fit list less the identity, measured on the rows."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for w, rows in _by_width(b, 0, shared.value):
                y = _whitened(_matrix(b.column(0).take(pa.array(rows)), w), shared.value[w])[0]
                y = np.hstack([np.ones((len(y), 1)), y])
                held[w] = held.get(w, 0) + y.T @ y
        for w, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([g.ravel()], pa.list_(pa.float64()))], ["width", "g"])

    part = fit.select(vec).mapInArrow(run, "width int, g array<double>").groupBy("width").agg(Summarizer.sum(array_to_vector("g")).alias("s"))
    out = {}
    for r in part.collect():  # a small matrix a length
        g = r["s"].toArray()
        k = int(round(len(g) ** 0.5))
        g = g.reshape(k, k) / g[0]
        off = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) - np.eye(k - 1)
        out[r["width"]] = float(np.abs(off).max()) if k > 1 else 0.0
    return out


def whiten(df: DataFrame, vec: str = "embedding", key: str = "vec_id", *, scale: int = 256, components: int = 4) -> DataFrame:
    """One row a vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; repeated rows and null keys are kept. The fit
    list is every distinct integer vector once, all of them. An empty table gives no rows.
    """
    x = df.where(present(vec)).select(F.col(key), integers(vec, scale).alias("x"))
    fit = cut_lineage(x.select("x").distinct(), "fit")
    models = learn(fit, components=components)
    errors = identity_errors(fit, models)
    facts = [(w, k + 1, int(m.n), float(m.values[k] / m.trace), errors.get(w, 0.0)) for w, m in models.items() for k in range(len(m.values))]
    facts = df.sparkSession.createDataFrame(facts, "w int, component int, n long, explained double, identity_error double")
    rows = apply(x, models).select(key, F.size("x").alias("w"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    rows = rows.withColumn("component", F.col("at") + 1)
    return rows.join(F.broadcast(facts), ["w", "component"]).select(key, "component", "n", "deviation", "whitened", "explained", "identity_error")
