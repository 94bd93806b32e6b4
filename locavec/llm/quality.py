"""Quality classifier: naive Bayes support vectors (log-count ratios times indicators, then a linear hinge-loss model).

Features are indicators of hashed one- and two-word sequences, of the words themselves and of their shapes (capital,
small, digit, other bytes kept, runs shortened), and of the share of different word pairs. Each is scaled by the log of the ratio of its smoothed share in the
two classes; rows are scaled to unit length; dual coordinate descent fits the hinge-loss model.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, arrow_map, bytes_of, chunks_of, hash_runs, mix, ngram_hashes, word_bounds

#: Bits of the feature space.
BITS = 20
#: Expected number of training rows (the fit is on a sample of that size; all labelled rows below it).
TRAIN_ROWS = 12_000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x61:0x7B] = 0x61
_SHAPE[0x30:0x3A] = 0x30
_SHAPE[0x80:] = 0x61


def features(col: pa.Array, bits: int = BITS):
    """Per chunk of rows: (first row, list of each row's distinct feature numbers)."""
    data, off = bytes_of(col)
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        tenths = (mix(np.arange(1000, 1011, dtype=np.uint64)) & mask).astype(np.int32)
        for i, j in chunks_of(off):
            raw = data[off[i]:off[j]]
            starts, ends, first = word_bounds(raw, off[i:j + 1] - off[i], SPACED)
            words = hash_runs(raw, starts, ends)
            s = _SHAPE[raw]
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            keep[starts] = True
            at = np.concatenate([[0], np.cumsum(keep)])
            shapes = hash_runs(s[keep], at[starts], at[ends]) if len(starts) else words
            kinds = [mix(words + np.uint64(1)), mix(shapes + np.uint64(2)), ngram_hashes(words, 2) + np.uint64(3), ngram_hashes(shapes, 2) + np.uint64(4)]
            kinds = [(k & mask).astype(np.int32) for k in kinds]
            rows = []
            for a, z in zip(first[:-1], first[1:]):
                e = max(a, z - 1)
                pairs = np.unique(kinds[2][a:e])
                # one more indicator: the tenth into which the share of different pairs falls
                share = tenths[10 * len(pairs) // (e - a)] if e > a else tenths[:0]
                rows.append(np.unique(np.concatenate([kinds[0][a:z], kinds[1][a:z], pairs, kinds[3][a:e], np.atleast_1d(share)])))
            yield i, rows


def log_ratios(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Log ratio of each feature's smoothed share of the positive and of the negative class's indicators."""
    p, q = np.ones(width), np.ones(width)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, *, c: float = 1.0,
                 epochs: int = 20, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of min 1/2 |w|^2 + c * sum of hinge losses, by dual coordinate descent.

    The offset is the weight of a constant feature 1. Stops when no projected gradient exceeds ``tolerance``.
    """
    w, bias, a = np.zeros(width), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (float(w[x] @ v) + bias) - 1.0
            pg = min(g, 0.0) if a[i] <= 0 else max(g, 0.0) if a[i] >= c else g
            if pg:
                worst = max(worst, abs(pg))
                new = min(max(a[i] - g / norm[i], 0.0), c)
                step = (new - a[i]) * y[i]
                a[i] = new
                w[x] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _unit(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[x].astype(np.float32)
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 else v


def learn(rows: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", *, bits: int = BITS,
          train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(log ratios, weights, offset) from the rows with a label.

    About ``train_rows`` rows at most, drawn by a hash of ``key``; labels above 0 are positive, null labels are left out.
    Rows of one class alone, or none, give a model that always says that class (class 1 without rows).
    """
    rows = rows.where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), (F.col(label) > 0).alias("y"))
    total = rows.select("y").count()
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("k", F.lit(29)), F.lit(1_000_000)) < F.lit(int(1e6 * train_rows / total)))

    def run(b):
        out = [x for _, part in features(b.column(0), bits) for x in part]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column(1)], ["x", "y"])

    got = arrow_map(rows.select("t", "y"), run, "x array<int>, y boolean").toArrow()
    x = [np.asarray(v.values) for c in got.column("x").chunks for v in c]  # views, not copies
    y = np.where(np.asarray(got.column("y")), 1.0, -1.0) if len(x) else np.zeros(0)
    # an order of rows that does not depend on partitioning
    order = sorted(range(len(x)), key=lambda i: (len(x[i]), zlib.crc32(x[i]), y[i]))
    x, y = [x[i] for i in order], y[order] if len(x) else y
    width = 1 << bits
    if not len(x) or abs(y.sum()) == len(x):
        return np.zeros(width), np.zeros(width), 1.0 if not len(x) else float(y[0])
    ratio = log_ratios(x, y, width)
    w, b = dual_descent(x, [_unit(r, ratio) for r in x], y, width)
    return ratio.astype(np.float32), w.astype(np.float32), b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", *, bits: int = BITS,
          out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score in 0..1 (a logistic curve of the margin) and the class at 0.5.

    Null and empty texts have the offset alone as margin. Existing columns with the names of ``out`` are replaced.
    """
    ratio, weight, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((ratio, ratio * weight))
    rest = [c for c in docs.columns if c not in out]
    at = rest.index(text)

    def run(b):
        r, rw = shared.value
        margin = np.empty(b.num_rows)
        for i, part in features(b.column(at), bits):
            for k, x in enumerate(part):
                v = r[x].astype(np.float64)
                n = float(np.sqrt(v @ v))
                margin[i + k] = (float(rw[x].astype(np.float64).sum()) / n if n > 0 else 0.0) + bias
        s = 1.0 / (1.0 + np.exp(-2.0 * margin))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return arrow_map(docs.select(*rest), run, f"{schema}, `{out[0]}` double, `{out[1]}` int")
