"""Benchmark decontamination: Wu-Manber search of benchmark word windows in whole documents.

The alphabet are 64-bit word hashes. For each window length L the block shift table gives, for the two words
that end at a position, how far the next possible window end is away (L - 1 if no window has the block); the smallest
shift wins where blocks fall into one slot. A shift of 0 sends the position to the bucket of its last and first block,
and the words of the bucket's windows are compared one by one. Many positions advance in lockstep.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, mix, word_chunks

#: Words in a window; slots of a shift table (bits); window ends that one cursor covers.
WINDOW, SLOT_BITS, SPAN = 10, 20, 512
#: Benchmark bytes searched for in one pass; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20


class Shifts:
    """Shift and bucket tables for windows of one length."""

    def __init__(self, windows: np.ndarray):
        self.windows = np.unique(windows, axis=0)
        self.length = self.windows.shape[1]
        self.block = min(2, self.length)
        self.table = np.full(1 << SLOT_BITS, self.length - self.block + 1, np.int32)
        with np.errstate(over="ignore"):
            for end in range(self.block - 1, self.length):
                slot = self._slot(self._blocks(self.windows, end))
                np.minimum.at(self.table, slot, self.length - 1 - end)
            key = self._bucket(self._blocks(self.windows, self.length - 1), self._blocks(self.windows, self.block - 1))
        order = np.argsort(key, kind="stable")
        self.windows, self.key = self.windows[order], key[order]

    def _blocks(self, w: np.ndarray, end: int) -> np.ndarray:
        return w[:, end] if self.block == 1 else mix(w[:, end - 1] * np.uint64(3) + w[:, end])

    @staticmethod
    def _slot(b: np.ndarray) -> np.ndarray:
        return (b >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return mix(last * np.uint64(5) + first)

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, window number) of every occurrence; ``first`` holds the first word of each row and the end."""
        a, z = first[:-1] + self.length - 1, first[1:]
        a, z = a[a < z], z[a < z]
        parts = -(-(z - a) // SPAN)
        row = np.repeat(np.arange(len(a)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = a[row] + part * SPAN
        stop = np.minimum(at + SPAN, z[row])
        ends, found = [], []
        with np.errstate(over="ignore"):
            while len(at):
                last = h[at] if self.block == 1 else mix(h[at - 1] * np.uint64(3) + h[at])
                shift = self.table[self._slot(last)]
                hit = np.flatnonzero(shift == 0)
                if len(hit):
                    e, s = at[hit], at[hit] - self.length + 1
                    head = h[s] if self.block == 1 else mix(h[s] * np.uint64(3) + h[s + 1])
                    key = self._bucket(last[hit], head)
                    lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                    n = hi - lo
                    e = np.repeat(e, n)
                    w = np.repeat(lo, n) + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
                    same = np.ones(len(e), bool)
                    for k in range(self.length):
                        same &= h[e - self.length + 1 + k] == self.windows[w, k]
                    ends.append(e[same])
                    found.append(w[same])
                at = at + np.maximum(shift, 1)
                go = at < stop
                at, stop = at[go], stop[go]
        none = np.zeros(0, np.int64)
        return (np.concatenate(ends), np.concatenate(found)) if ends else (none, none)


class Index:
    """Windows of benchmark items by length, and the items of each window."""

    def __init__(self, items: list, texts: list[str | None], window: int = WINDOW):
        by: dict[int, list[np.ndarray]] = {}
        own: dict[int, list[np.ndarray]] = {}
        for i, h, first in word_chunks(pa.array(texts, pa.large_string()), ALNUM):
            for k, (a, z) in enumerate(zip(first[:-1], first[1:])):
                size = min(window, z - a)
                if size:
                    w = np.lib.stride_tricks.sliding_window_view(h[a:z], size)
                    by.setdefault(size, []).append(w)
                    own.setdefault(size, []).append(np.full(len(w), i + k))
        self.names = [None if i is None else str(i) for i in items]
        self.lengths = []
        for size in sorted(by):
            t = Shifts(np.concatenate(by[size]))
            # items of each window, by its number in the table
            which = {w.tobytes(): n for n, w in enumerate(t.windows)}
            of: list[list[int]] = [[] for _ in range(len(t.windows))]
            for w, i in zip(np.concatenate(by[size]), np.concatenate(own[size])):
                of[which[w.tobytes()]].append(int(i))
            self.lengths.append((t, [sorted(set(x)) for x in of]))

    def match(self, col: pa.Array):
        """Per row: (words, hit intervals, item names)."""
        for _, h, first in word_chunks(col, ALNUM):
            spans = [[] for _ in range(len(first) - 1)]
            items: list[set] = [set() for _ in range(len(first) - 1)]
            for t, of in self.lengths:
                ends, w = t.search(h, first)
                rows = np.searchsorted(first, ends, "right") - 1
                for e, n, r in zip(ends.tolist(), w.tolist(), rows.tolist()):
                    spans[r].append((e - t.length + 1 - int(first[r]), e + 1 - int(first[r])))
                    items[r].update(self.names[i] for i in of[n])
            for r in range(len(first) - 1):
                yield int(first[r + 1] - first[r]), _merged(spans[r]), sorted(x for x in items[r] if x is not None)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals in order."""
    out: list[list[int]] = []
    for a, z in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def find(docs: DataFrame, benchmark: DataFrame, *, key: str = "item_id", item_text: str = "text", text: str = "text",
         window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (array of word intervals start, stop) and items (sorted item keys as strings).

    A null text has no words; an item without words has no window; an item whose key is null marks words but is not
    listed. Equal items are all listed. Existing columns with these names are replaced. The benchmark is read in groups of at most
    ``pass_bytes`` (an item is never split): one group is searched for in one pass over the documents, more groups
    in one pass each, joined by row.
    """
    names = ("n_words", "hits", "items")
    rest = [c for c in docs.columns if c not in names]
    at = rest.index(text)
    base = docs.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    added = "n_words long, hits array<struct<start:long,stop:long>>, items array<string>"
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))

    def one(frame: DataFrame, part: DataFrame, keep: list[str], where: int, ddl: str) -> DataFrame:
        got = part.select(F.col(key).alias("k"), F.col(item_text).alias("t")).toArrow()
        index = Index(got.column("k").to_pylist(), got.column("t").to_pylist(), window)
        shared = frame.sparkSession.sparkContext.broadcast(index)
        places = [frame.columns.index(c) for c in keep]

        def run(b):
            m = list(shared.value.match(b.column(where)))
            hits = [[{"start": a, "stop": z} for a, z in x[1]] for x in m]
            return pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in places], pa.array([x[0] for x in m], pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([x[2] for x in m], pa.list_(pa.string()))],
                [*keep, *names])

        return arrow_map(frame, run, f"{ddl}, {added}" if ddl else added)

    if passes == 1:
        return one(base, benchmark, rest, at, schema)
    from ..session import cut_lineage

    numbered = cut_lineage(base.select(F.monotonically_increasing_id().alias("row"), F.struct(*rest).alias("all"), F.col(text).alias("text")), "decontam")
    # about twice as many groups as the mean needs, so that a group of hashed items stays near the bound
    groups = F.pmod(F.xxhash64(item_text), F.lit(2 * passes))
    found = None
    for p in range(2 * passes):
        part = one(numbered.select("row", "text"), benchmark.where(groups == p), ["row"], 1, "row long")
        found = part if found is None else found.union(part)
    total = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    merged = F.aggregate(F.array_sort("hits"), empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(x))))
    return numbered.join(total, "row").select("all.*", "n_words", merged.alias("hits"), "items")


def digest(found: DataFrame) -> DataFrame:
    """``hits`` and ``items`` as n_hit, n_items, items_sha256 (of the comma-joined keys) and contaminated."""
    n = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.withColumns({"n_hit": n, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items"), 256), "contaminated": n > 0}).drop("hits", "items")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
