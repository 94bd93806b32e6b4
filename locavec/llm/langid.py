"""Language identification with rank-order n-gram profiles.

The n-grams (one to three characters over letters, every run of other characters counting as one space) of each
language's training texts are ranked by frequency; the ``size`` most frequent make its profile. A document's own most
frequent n-grams are ranked the same way, and each language costs the sum over them of the distance between the two
ranks, or ``size`` for an n-gram outside the profile. The cheapest language wins, ties by name.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map

UNKNOWN = "und"
#: Ranks in a profile.
SIZE = 400
#: Expected number of training texts per language (the fit is on a sample of that size; all texts below it).
TRAIN_TEXTS = 20_000
_PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other characters as one 0, one 0 at either end; empty without letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[x]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, x, 0)[keep].astype(np.int64)
    return np.concatenate([[0] if c[0] else [], c, [0] if c[-1] else []]).astype(np.int64)


def _counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the codes as exact 63-bit numbers, with their counts; long texts piece by piece."""
    parts = []
    for i in range(0, max(len(c) - 1, 1), _PIECE):
        p = c[i:i + _PIECE + 2]
        own = p[:_PIECE]
        two = p[:-1] << 21 | p[1:]
        three = (p[:-2] << 42 | p[1:-1] << 21 | p[2:]) if len(p) > 2 else p[:0]
        parts.append(np.unique(np.concatenate([own[own > 0], two[:_PIECE] | 1 << 62, three[:_PIECE]]), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _ranked(g: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by number."""
    if len(g) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        g, n = g[keep], n[keep]
    return g[np.argsort(-n, kind="stable")][:size]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, size: int = SIZE,
          train_texts: int = TRAIN_TEXTS) -> dict[str, np.ndarray]:
    """Profiles by language from the rows whose ``lang`` is not null.

    At most about ``train_texts`` texts of a language are read, drawn by a hash of ``key``. Texts that are null or
    without letters teach nothing; a language with no others has no profile.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {}
    share = F.create_map(*[F.lit(x) for l, n in totals.items() for x in (l, min(1.0, train_texts / n))])
    draw = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1_000_000)) / F.lit(1e6)
    rows = rows.where(draw < F.element_at(share, F.col("l"))).select("l", "t")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = _codes(t or "")
                if len(c):
                    d = total.setdefault(l, {})
                    for g, n in zip(*(a.tolist() for a in _counts(c))):
                        d[g] = d.get(g, 0) + n
        for l, d in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(d)), pa.array(list(d), pa.int64()), pa.array(list(d.values()), pa.int64())], ["l", "g", "n"])

    sums = cut_lineage(rows.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "langid")
    out = {}
    for l in sorted(totals):
        best = sums.where(F.col("l") == l).orderBy(F.desc("n"), "g").limit(size).select("g").collect()
        if best:
            out[l] = np.array([r["g"] for r in best], np.int64)
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", *, size: int = SIZE,
             out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 (no n-gram in the profile) to 1 (the profile's very order).

    Null texts and texts without letters give ``und`` and 0, as does every text where no profile was learned. Existing
    columns with the names of ``out`` are replaced.
    """
    names = sorted(profiles)
    every = np.unique(np.concatenate([profiles[l] for l in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(every) + 1), -1, np.int64)
    for i, l in enumerate(names):
        ranks[i, np.searchsorted(every, profiles[l])] = np.arange(len(profiles[l]))
    rest = [c for c in docs.columns if c not in out]
    at = rest.index(text)

    def judge(t: str | None) -> tuple[str, float]:
        c = _codes(t or "")
        if not len(c) or not names:
            return UNKNOWN, 0.0
        g = _ranked(*_counts(c), size)
        p = np.searchsorted(every, g)
        r = ranks[:, np.where(every[np.minimum(p, len(every) - 1)] == g, p, len(every))]
        cost = np.where(r < 0, size, np.abs(r - np.arange(len(g)))).sum(1)
        k = int(cost.argmin())
        return names[k], 1.0 - float(cost[k]) / (size * len(g))

    def run(b):
        found = [judge(t) for t in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                          [*rest, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return arrow_map(docs.select(*rest), run, f"{schema}, `{out[0]}` string, `{out[1]}` double")


def accepted(lang: str = "lang_pred", score: str = "score", least: float = 0.05) -> Column:
    """Rows whose language is known and whose text is near its profile at all."""
    return (F.col(lang) != UNKNOWN) & (F.col(score) >= least)
