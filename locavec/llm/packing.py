"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length, exact over all documents.

What best fit decreasing does with a piece depends on its length alone, so the packing is computed on the histogram of lengths
(as many numbers as the sequence has tokens) and then dealt out to the pieces by their rank among those of
their length. The plan keeps, for each remaining capacity, the runs of equal open sequences; a segment tree over the
capacities gives the tightest one that still holds a length in logarithmic time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map

SEQUENCE, END_ID = 2048, 0
_SPECIAL = "<|endoftext|>"
_loaded: dict[str, tuple] = {}


def tokenizer(json_path: str | None = None, ranks_path: str | None = None):
    """A function from texts to id arrays, the ids that `tokenizers` gives with the vocabulary at ``json_path``.

    Texts are encoded with the same vocabulary's rank table, which gives the same ids several times faster; texts that
    spell a special token, which the rank table does not know, go through `tokenizers` itself.
    """
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    json_path, ranks_path = json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken")
    if (json_path, ranks_path) not in _loaded:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[json_path, ranks_path] = (Tokenizer.from_file(json_path), tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    slow, fast = _loaded[json_path, ranks_path]

    def encode(t: str) -> np.ndarray:
        if _SPECIAL in t:
            return np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(t), np.uint32)

    return encode


class Tightest:
    """Segment tree over the capacities 0..size: whether any run is open at each, and the least open one from a bound on."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.any = [False] * (2 * self.base)

    def set(self, c: int, value: bool) -> None:
        i = c + self.base
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, c: int) -> int | None:
        """The least open capacity of at least ``c``."""
        i = c + self.base
        if self.any[i]:
            return c
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def plan(counts: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Best fit decreasing on ``counts`` (pieces of each length 0..size).

    Rows (length, first rank, pieces, pieces to a sequence, first sequence, offset): the pieces of this length with ranks
    from the first rank on are put, so many to a sequence, into consecutive sequences from the first on, at this
    offset. Equal open sequences take their pieces together, which is what the one-by-one order gives: a sequence that
    still holds the length after taking a piece is then the tightest.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by capacity: (first sequence, number)
    tree, out, opened = Tightest(size), [], 0
    for length in range(size, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            c = tree.least(length)
            if c is None:  # open as many new sequences as the rest needs
                n = -(-left // (size // length))
                first, c, offset, fresh = opened, size, 0, True
                opened += n
            else:
                first, n = runs[c].pop()
                fresh, offset = False, size - c
            each = c // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, each, first, offset))
                runs[c - each * length].append((first, full))
                tree.set(c - each * length, True)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and full < n:  # one more takes fewer than it could
                out.append((length, rank, left, left, first + full, offset))
                runs[c - left * length].append((first + full, 1))
                tree.set(c - left * length, True)
                rank, left, used = rank + left, 0, full + 1
            if used < n and not fresh:
                runs[c].append((first + used, n - used))
            if not fresh:
                tree.set(c, bool(runs[c]))
    return np.array(out, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = SEQUENCE, end_id: int = END_ID,
           keep_ids: bool = True, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids (or only their ids_crc32), and the piece's number in its task.

    Each text's ids and one ``end_id``; longer ones are cut into pieces of ``size``, the first of which may be shorter. Null texts
    are empty. The table is written to the shared folder, so that the numbers stay when an executor is lost.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = tokenizer(json_path, ranks_path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            keys, number, start, length, ids, crc, local = [], [], [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(x) % size or size
                cuts = [0, *range(first, len(x) + 1, size)]
                for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    keys.append(k)
                    number.append(p)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(x[a:z].tobytes()))
                    if keep_ids:
                        ids.append(x[a:z].astype(np.int32))
                    local.append(int(seen[z - a]))
                    seen[z - a] += 1
            cols = [pa.array(keys, b.column(0).type), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([task] * len(keys), pa.int64()), pa.array(local, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32", "task", "local"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    ddl = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task long, local long" + ", ids array<int>" * keep_ids
    return cut_lineage(docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl), "pieces")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = SEQUENCE, keep_ids: bool = True, **how) -> DataFrame:
    """Pieces with their sequence_id and offset: best fit decreasing over all documents.

    Repeated rows are packed as often as they occur. An empty table gives no row.
    """
    p = pieces(docs, key, text, size=size, keep_ids=keep_ids, **how)
    per = cut_lineage(p.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    steps = plan(counts, size)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(steps[order])
    before = per.select("task", "length", (F.sum("n").over(_tasks()) - F.col("n")).alias("before"))
    ranked = p.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "task")
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    keep = [c for c in ranked.columns if c != "rank"]
    places = [ranked.columns.index(c) for c in keep]

    def run(b):
        s = shared.value
        length, rank = np.asarray(b.column(at_length)), np.asarray(b.column(at_rank))
        # the last step of the length that begins at or before the rank
        big = np.int64(1) << 44
        i = np.searchsorted(s[:, 0] * big + s[:, 1], length * big + rank, "right") - 1
        q = rank - s[i, 1]
        seq, offset = s[i, 4] + q // s[i, 3], s[i, 5] + (q % s[i, 3]) * length
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in places], pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*keep).schema)
    return arrow_map(ranked, run, f"{ddl}, sequence_id long, offset long")


def _tasks():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("task")
