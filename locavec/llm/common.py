"""Shared helpers: tables, row-wise Arrow functions, word hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it (column names do not tell capitals from small letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str, rows: int | None = None) -> DataFrame:
    """``fn`` on every Arrow batch, or on its slices of ``rows`` rows; the result may be one batch or several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in [whole] if rows is None else (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                out = fn(b)
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def ints(a, kind=pa.int64()) -> pa.Array:
    return pa.array(np.ascontiguousarray(a), type=kind)


# ---------------------------------------------------------------- words


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes inside the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: Bytes of `[^\x20\x09-\x0D]+` words.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_LETTER = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; kept up to the chunk size only."""
    if "p" in _powers and len(_powers["p"]) >= n:
        return _powers["p"], _powers["q"]
    size, out = max(n, (1 << 20) + 1), []
    for base in (_BASE, _INVERSE):
        a = np.full(size, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    if size == (1 << 20) + 1:
        _powers["p"], _powers["q"] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    n = len(col)
    o = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def chunks_of(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def hash_runs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, a function of their bytes alone."""
    p, q = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_LETTER[b] * p[:len(b)], out=h[1:])
        return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_bounds(b: np.ndarray, rows: np.ndarray, inside: np.ndarray):
    """Starts and ends of the words of a chunk, and the first word of each row; ``rows`` are byte offsets."""
    w = inside[b]
    before = np.empty(len(b), bool)
    after = np.empty(len(b), bool)
    if len(b):
        before[0] = after[-1] = False
        before[1:], after[:-1] = w[:-1], w[1:]
        cut = rows[(rows > 0) & (rows < len(b))]
        before[cut] = False
        after[cut - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def word_chunks(col: pa.Array, inside: np.ndarray, size: int = 1 << 20):
    """Per chunk of rows: first row, word hashes, and the offset of each row's first word (one more at the end)."""
    data, off = bytes_of(col)
    for i, j in chunks_of(off, size):
        b = LOWER[data[off[i]:off[j]]]
        starts, ends, first = word_bounds(b, off[i:j + 1] - off[i], inside)
        yield i, hash_runs(b, starts, ends), first


def word_arrays(col: pa.Array, inside: np.ndarray, fold: bool = False, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Per chunk of rows: first row, its words as a string array (``fold``: A-Z lower-cased), and the offset of each row's first word
    (one more at the end)."""
    data, off = bytes_of(col)
    for i, j in chunks_of(off, size):
        b = data[off[i]:off[j]]
        starts, ends, first = word_bounds(b, off[i:j + 1] - off[i], inside)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        kept = np.ascontiguousarray(b[inside[b]])
        yield i, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(LOWER[kept] if fold else kept)), first


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position, for the positions that have n words after them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k:k + m])
    return out


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components", max_rounds: int = 64) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (columns a, b): columns node, component.

    Alternates the large-star and the small-star step: each moves the neighbours of a node to its least
    neighbour, the first those above the node, the second those below. Only a minimum per node is
    aggregated, so that a hub is never gathered; every round is written to the shared folder. Stops when a round
    changes nothing. Loops and nulls are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct()
    e = cut_lineage(e, name)
    nodes = e

    def mark(df):
        return tuple(df.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old = mark(e)
    for _ in range(max_rounds):
        if not old[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u != v").distinct()
        lead = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(lead, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = cut_lineage(small.select("x.u", "x.v").where("u != v").distinct(), name)
        new = mark(e)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        nodes.select(F.explode(F.array("u", "v")).alias("node")).join(e.select(F.col("u").alias("node")), "node", "left_anti")
        .select("node", F.col("node").alias("component")).distinct())
