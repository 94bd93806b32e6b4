"""Shards by Hilbert-curve order: several metadata dimensions are quantised, rows are sorted by their index on the curve
through the cells, and the order is cut into runs of equal row counts. A reader that asks for a range of any dimension
then skips most files. One law holds: row counts of two shards differ by one at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, fresh

#: Bits per dimension.
BITS = 8


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of the cells ``x`` (rows × dimensions, each in 0..2**bits - 1); bits × dimensions <= 62."""
    x = np.array(x, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of the sub-cubes
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def quantised(df: DataFrame, dims: Sequence[Column], bits: int = BITS) -> list[Column]:
    """Cell numbers of the dimensions: a numeric one by its quantiles over all rows, a text one by a hash of its value
    (equal values share a cell). Null is cell 0."""
    top = (1 << bits) - 1
    named = df.select(*[d.alias(f"d{i}") for i, d in enumerate(dims)])
    kinds = [f.dataType.typeName() for f in named.schema]
    numeric = [f"d{i}" for i, k in enumerate(kinds) if k != "string"]
    cuts = dict(zip(numeric, named.select(*[F.col(c).cast("double") for c in numeric]).approxQuantile(
        numeric, [i / top for i in range(1, top)], 0.25 / top))) if numeric else {}
    out = []
    for i, d in enumerate(dims):
        c = cuts.get(f"d{i}")
        if c is None:
            cell = F.pmod(F.xxhash64(d), F.lit(top)) + 1
        else:
            edges = sorted(set(c))
            v = d.cast("double")
            cell = F.when(v.isNotNull(), F.coalesce(_bucket(v, edges), F.lit(0)) + 1)
        out.append(F.coalesce(cell, F.lit(0)).cast("int"))
    return out


def _bucket(v: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    return F.call_function("array_size", F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= v)) if edges else F.lit(0)


def assign(df: DataFrame, dims: Sequence[Column], shards: int, tie: Sequence[str], bits: int = BITS) -> DataFrame:
    """``df`` with curve (index), shard (0..shards - 1) and slot (gapless from 0 within the shard).

    Rows with one index stand in the order of ``tie``; fully equal rows in any. A cell with many rows is cut like any other run.
    The order is made by a range partitioning on index and tie, written to the shared folder, and ranks are the
    offset of the part plus the place in it. Fewer rows than shards leave the last shards empty. Existing columns with
    these names are replaced.
    """
    keep = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    at, spot, held, front, rank = (fresh(df, c) for c in ("__at", "__cells", "__part", "__before", "__rank"))
    cells = df.select(*keep, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quantised(df, dims, bits))]).alias(spot))

    width = len(dims)

    def run(b):
        x = np.stack([np.asarray(f) for f in b.column(len(keep)).flatten()], axis=1) if b.num_rows else np.zeros((0, width), np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(hilbert_index(x, bits), pa.int64())], [*keep, "curve"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    order = ["curve", *tie]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = arrow_map(cells, run, f"{ddl}, curve long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn(at, F.monotonically_increasing_id()), "curve")
    part, local = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row per part
    total = sum(n for _, n in sizes)
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], f"`{held}` long, `{front}` long")
    ranked = placed.join(F.broadcast(offsets), part == F.col(held)).withColumn(rank, F.col(front) + local)
    least, more = divmod(total, shards)  # the first ``more`` shards hold one row more
    edge = more * (least + 1)
    r = F.col(rank)
    small = F.lit(more) + F.floor((r - edge) / F.lit(max(least, 1)))
    shard = F.when(r < edge, F.floor(r / F.lit(least + 1))).otherwise(small).cast("int")
    slot = F.when(r < edge, r % F.lit(least + 1)).otherwise((r - edge) % F.lit(max(least, 1)))
    return ranked.select(*keep, "curve", shard.alias("shard"), slot.cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; within a folder rows keep the order of the curve."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
