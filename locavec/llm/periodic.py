"""Periodic run detection: seeds on the minimum guaranteed overlap of a run, extended along their diagonal.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` and ``min_repeats`` * q words long, that
cannot be extended. On the diagonal of lag q it is a stretch of equal words (x and x + q) of length - q words, so it holds a
k-gram and the same k-gram q words on, for every k up to ``min_repeats`` * q - q and ``min_words`` - q. The first index takes the
largest power of two that every lag guarantees (16 for 24 words and 3 repeats); lags above it guarantee more than twice the lag,
so lags in (k / 2, k] are looked up in the index of k-grams, k doubling up to the text's length.

Where k >= q, two equal k-grams inside a run with smallest period q are never closer than q (a closer one at distance d would
make d a period of q + d words, and with it the common divisor of d and q a period of the run). So the pairs of neighbouring
occurrences hold every run at its smallest period and at no multiple of it, and a word repeated a million times gives a million
pairs, not their square. k-grams are named exactly (a name is a number for a pair of names of k / 2), never by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, arrow_map, fresh, word_arrays


def codes_of(words: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words of the array."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions whose key occurs again, with a name per key and the next position of the same key (-1 for the last)."""
    order = np.argsort(key, kind="stable")
    k, p = key[order], pos[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = same[1:] | same[:-1]
    name = np.cumsum(~same[:-1])
    after = np.where(same[1:], np.append(p[1:], -1), -1)
    p, name, after = p[again], name[again], after[again]
    back = np.argsort(p)
    return p[back], name[back], after[back]


def _mismatch(codes: np.ndarray, x: int, stop: int, lag: int, step: int) -> int:
    """First position from ``x`` towards ``stop`` (exclusive) whose word differs from the one ``lag`` words on, else ``stop``."""
    width = 32
    while x != stop:
        y = min(x + width, stop) if step > 0 else max(x - width, stop)
        a, b = (x, y) if step > 0 else (y + 1, x + 1)
        bad = np.flatnonzero(codes[a:b] != codes[a + lag:b + lag])
        if len(bad):
            return a + int(bad[0] if step > 0 else bad[-1])
        x, width = y, 2 * width
    return stop


def find_runs(codes: np.ndarray, first: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> np.ndarray:
    """All runs of the rows as (row, start, length, period), by row, start and period.

    ``codes`` holds the words of all rows, ``first`` the offset of each row and the end.
    """
    if min_repeats < 3 or min_words < 2:
        raise ValueError("a run needs at least three repeats and two words")
    guaranteed = min(max(min_words, min_repeats * q) - q for q in range(1, min_words + 1))
    seed = 1 << (guaranteed.bit_length() - 1)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pos, name, after = _repeated((rows << 32) | codes, np.arange(len(codes)))
    names = np.full(len(codes), -1, np.int64)
    found, k = [], 1
    while len(pos):
        if k >= seed:
            lag = after - pos
            near = (after >= 0) & (lag <= k) & ((lag > k // 2) | (k == seed))
            found += _extended(codes, first, rows, pos[near], lag[near], k, min_words, min_repeats)
        # names of 2k-grams: pairs of names of k-grams that both occur again
        names[:] = -1
        names[pos] = name
        pos = pos[pos + k < len(codes)]
        pos = pos[names[pos + k] >= 0]
        pos, name, after = _repeated((names[pos] << 32) | names[pos + k], pos)
        k *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _extended(codes, first, rows, pos, lag, k, min_words, min_repeats) -> list[tuple[int, int, int, int]]:
    """Runs on the diagonals of the given seed pairs (pos, pos + lag), whose k-grams are equal."""
    if not len(pos):
        return []
    order = np.lexsort((pos, lag))
    pos, lag = pos[order], lag[order]
    # neighbouring seeds of one lag are one stretch already
    new = np.ones(len(pos), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (pos[1:] != pos[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(pos)) - 1
    covered: dict[int, int] = {}  # per lag: end of the furthest stretch
    out = []
    for p, last, q in zip(pos[heads].tolist(), pos[tails].tolist(), lag[heads].tolist()):
        if last < covered.get(q, 0):
            continue
        row = int(rows[p])
        low, high = int(first[row]), int(first[row + 1])
        end = _mismatch(codes, last + k, high - q, q, 1)
        start = _mismatch(codes, p - 1, low - 1, q, -1) + 1
        covered[q] = end
        length = end - start + q
        if length >= max(min_words, min_repeats * q):
            out.append((row, start - low, length, q))
    return out


def detect(docs: DataFrame, text: str = "text", *, min_words: int = 24, min_repeats: int = 3,
           out: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """``docs`` with the number of words, the runs (start, length, period; by start, then period) and the text without repeats.

    The last is every word that no run holds after its first period, joined by one space. Words are `[^\\x20\\x09-\\x0D]+`.
    A null or empty text has no words, no runs and an empty result. Each row is judged by itself, so repeated rows, null keys and
    an empty table need no care. Existing columns with the names of ``out`` are replaced (``text`` must not be one of them).
    """
    rest = [c for c in docs.columns if c not in out]
    at = rest.index(text)
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(b):
        counts, runs, kept = [], [], []
        for _, words, first in word_arrays(b.column(at), SPACED):
            r = find_runs(codes_of(words), first, min_words, min_repeats)
            turn = np.zeros(len(words) + 1, np.int64)
            begin = first[r[:, 0]] + r[:, 1]
            np.add.at(turn, begin + r[:, 3], 1)
            np.add.at(turn, begin + r[:, 2], -1)
            keep = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
            counts.append(np.diff(first))
            offsets = np.searchsorted(r[:, 0], np.arange(len(first))).astype(np.int32)
            runs.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(r[:, c]) for c in (1, 2, 3)], fields=list(entry))))
            lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(keep, first)), words.take(pa.array(keep)))
            kept.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        one = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(n), one(runs, pa.list_(entry)), one(kept, pa.string())], [*rest, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return arrow_map(docs.select(*rest), run, f"{schema}, `{out[0]}` long, `{out[1]}` array<struct<start:long,length:long,period:long>>, `{out[2]}` string")


def strongest(runs: str) -> Column:
    """The run with the greatest exact length / period (first of equal ones), null without runs."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(F.col(runs), none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def plant(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a periodic end in the texts of a tenth of the keys.

    With h = crc32 of the key as text and g = h // 10, where 10 divides h, word i >= a becomes word a + (i - a) % p with
    a = g % n and p = 1 + (n - a) // (3 + g % 8), and the words are joined by one space. Texts without words and rows without a
    key stay as they are.
    """
    names = docs.columns
    at = names.index(text)

    def run(b):
        texts, h = b.column(at), b.column(b.num_columns - 1)
        chosen = np.flatnonzero(pc.fill_null(pc.less(h, pa.scalar(0, pa.int64())), True).to_numpy(zero_copy_only=False) == 0)
        chosen = chosen[h.take(pa.array(chosen)).to_numpy(zero_copy_only=False) % 10 == 0]
        new = {}
        for i, words, first in word_arrays(texts.take(pa.array(chosen)), SPACED):
            for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                n, row = hi - lo, int(chosen[i + k])
                if n:
                    g = h[row].as_py() // 10
                    a = g % n
                    at_word = np.arange(n)
                    at_word[a:] = a + (at_word[a:] - a) % (1 + (n - a) // (3 + g % 8))
                    new[row] = " ".join(words.take(pa.array(lo + at_word)).to_pylist())
        mask = np.zeros(b.num_rows, bool)
        mask[list(new)] = True
        done = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[r] for r in sorted(new)], texts.type))
        return pa.RecordBatch.from_arrays([done if c == at else b.column(c) for c in range(len(names))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    return arrow_map(docs.select("*", h.alias(fresh(docs, "__h"))), run, schema)
