"""Language-model scoring with a hidden Markov model over words.

Baum-Welch counts are added over all training documents, task by task; the scaled forward recursion gives the exact probability of a
whole text under the model. Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end of text.

The word counts are a table of their own that grows with the corpus. A word is in the head if its count is at least N / HEAD (so
the head holds at most HEAD words whatever the corpus) and at least LEAST; only the head and one class for all other words have
probabilities per state. A word of that class has its share of the class, (c + 1) / (sum of (c + 1) over the class + 1), the last 1
for all words never seen. Head probabilities are broadcast; the shares come from a join by word, where no key can be hot, since every
frequent word is in the head.

The recursion runs for many rows at once. A row longer than SEGMENT words is cut into segments: each later one is first run from every
state, which gives a matrix, the matrices of a row are chained, and so every segment gets its true first and last state vectors.
Nothing is approximated by the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACED, fresh, word_arrays

#: Most words of the head.
HEAD = 1 << 18
#: Least count of a head word, and its greatest length in bytes (longer ones stay in the class of other words).
LEAST, WIDEST = 4, 256
#: The end of a text, which no word can be.
END = " "
STATES = 8
SEGMENT = 512
#: State vectors are scaled to 1 once in so many words (and at the end of a segment); in between they shrink by word probabilities.
SCALED = 4
#: Tokens worked on at once, and codes whose counts travel in one row.
BATCH, BLOCK = 1 << 18, 1 << 10
#: Rounds of Baum-Welch over all training documents, and before them over one in START_SHARE of them, for a first model.
ROUNDS, START_ROUNDS, START_SHARE = 4, 10, 64
#: Weight, in tokens, of the corpus-wide probabilities in those of a state, and of the uniform in moves and first states.
PRIOR, PRIOR_MOVE = 64.0, 1.0


# ---------------------------------------------------------------- the recursions


@dataclass(frozen=True)
class Model:
    """First-state probabilities (K), moves (K x K) and emissions (codes x K, each column adds up to 1)."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def single(self) -> tuple[Model, np.ndarray]:
        """The model in single precision, each code's emissions over their greatest, and the logs of these. Expected counts do not depend
        on a factor common to the states, and so no product of emissions leaves the range."""
        top = self.emit.max(1)
        return Model(self.first.astype("f4"), self.move.astype("f4"), (self.emit / top[:, None]).astype("f4")), np.log(top)


@dataclass
class Stats:
    """Expected counts: first states, moves, emissions; and the log probability of the rows."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    loglik: float = 0.0


class Segments:
    """The segments of some rows, and the order in which all are advanced word by word."""

    def __init__(self, offsets: np.ndarray, size: int = SEGMENT):
        n = np.diff(offsets)
        count = -(-n // size)
        self.base = np.concatenate([[0], np.cumsum(count)])  # first segment of each row
        self.row = np.repeat(np.arange(len(n)), count)
        self.number = np.arange(len(self.row)) - self.base[self.row]
        self.start = offsets[self.row] + self.number * size
        self.length = np.minimum(offsets[self.row + 1] - self.start, size)

    def walk(self, ids: np.ndarray):
        """(order of ``ids`` by falling length, tokens in the order of the walk, bounds of each step)."""
        ids = ids[np.argsort(-self.length[ids], kind="stable")]
        length, start = self.length[ids], self.start[ids]
        steps = int(length[0]) if len(ids) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")  # segments longer than t
        tokens = np.concatenate([start[:m] + t for t, m in enumerate(active)]) if steps else np.zeros(0, np.int64)
        return ids, tokens, np.concatenate([[0], np.cumsum(active)])


def _forward(b: np.ndarray, bounds: np.ndarray, prior: np.ndarray, move: np.ndarray, keep: bool = False):
    """Last scaled state vectors, log scales, and with ``keep`` all vectors, each up to a factor.

    ``b`` has the emissions in the order of the walk, ``prior`` the state probabilities before the first emission, either a vector or
    a matrix (one row a starting state) per segment.
    """
    k = move.shape[0]
    wide = prior.ndim == 3
    last, logs = np.empty_like(prior), np.zeros(len(prior))
    every = np.empty_like(b) if keep else None
    a = prior
    for t in range(len(bounds) - 1):
        lo, hi = bounds[t], bounds[t + 1]
        m = hi - lo
        if m < len(a):
            last[m:len(a)] = a[m:]
            a = a[:m]
        if t:
            a = (a.reshape(-1, k) @ move).reshape(a.shape)
        a = a * (b[lo:hi, None, :] if wide else b[lo:hi])
        if t % SCALED == 0 or m > (bounds[t + 2] - hi if t + 2 < len(bounds) else 0):
            s = a.reshape(m, -1) @ np.ones(a[0].size, a.dtype)
            a /= s[:, None, None] if wide else s[:, None]
            logs[:m] += np.log(s)
        if keep:
            every[lo:hi] = a
    last[:len(a)] = a
    return last, logs, every


def _linked(model: Model, b_all: np.ndarray, seg: Segments):
    """State vectors at the border of segments and the log probability per row.

    Returns (vectors after each segment, matrices of the segments that are not the first of their row, the row's log probability).
    """
    k = len(model.first)
    heads, later = np.flatnonzero(seg.number == 0), np.flatnonzero(seg.number > 0)
    after, scale = np.empty((len(seg.row), k), b_all.dtype), np.zeros(len(seg.row))
    ids, tokens, bounds = seg.walk(heads)
    last, logs, _ = _forward(b_all[tokens], bounds, np.broadcast_to(model.first, (len(ids), k)), model.move)
    after[ids], scale[ids] = last, logs
    matrices = np.empty((len(seg.row) if len(later) else 0, k, k), b_all.dtype)
    if len(later):
        ids, tokens, bounds = seg.walk(later)
        last, logs, _ = _forward(b_all[tokens], bounds, np.broadcast_to(model.move, (len(ids), k, k)), model.move)
        matrices[ids], scale[ids] = last, logs
        by_number = later[np.argsort(seg.number[later], kind="stable")]
        cuts = np.flatnonzero(np.diff(seg.number[by_number])) + 1
        for at in np.split(by_number, cuts):
            v = np.einsum("mi,mij->mj", after[at - 1], matrices[at])
            s = v.sum(1)
            after[at] = v / s[:, None]
            scale[at] += np.log(s)
    return after, matrices, np.bincount(seg.row, scale, len(seg.base) - 1)


def log_likelihood(model: Model, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each row of codes (every row has one code at least)."""
    return _linked(model, model.emit[codes], Segments(offsets))[2]


def expected_counts(model: Model, codes: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> Stats:
    """Baum-Welch counts of the rows under the model, in the precision of its arrays."""
    k, seg, b_all = len(model.first), Segments(offsets, size), model.emit[codes]
    after, matrices, loglik = _linked(model, b_all, seg)
    # state vectors from behind, at the last word of each segment
    behind = np.full((len(seg.row), k), 1.0 / k, b_all.dtype)
    if len(matrices):
        inner = np.flatnonzero(np.append(seg.number[1:] > 0, False))  # a segment follows in the same row
        by_number = inner[np.argsort(-seg.number[inner], kind="stable")]
        for at in np.split(by_number, np.flatnonzero(np.diff(seg.number[by_number])) + 1):
            v = np.einsum("mij,mj->mi", matrices[at + 1], behind[at + 1])
            behind[at] = v / v.sum(1, keepdims=True)
    before = np.empty_like(behind)  # state vector at the last word of the segment before
    before[1:] = after[:-1]
    ids, tokens, bounds = seg.walk(np.arange(len(seg.row)))
    b, head = b_all[tokens], seg.number[ids] == 0
    prior = np.where(head[:, None], model.first, before[ids] @ model.move)
    _, _, a = _forward(b, bounds, prior, model.move, keep=True)
    pairs, first = np.zeros((k, k)), np.zeros(k)  # in double
    end, ones = behind[ids], np.ones(k, b.dtype)
    for t in range(len(bounds) - 2, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        z = end[:hi - lo].copy()
        if t + 2 < len(bounds):
            m = bounds[t + 2] - hi
            v = b[hi:hi + m] * beta
            z[:m] = v @ model.move.T
            u = a[lo:lo + m]
            pairs += u.T @ (v / ((u @ model.move * v) @ ones)[:, None])
        if t % SCALED == 0:
            z /= (z @ ones)[:, None]
        beta = z
        if t == 0:
            later = ~head
            if later.any():
                u, v = before[ids][later], b[:hi][later] * beta[later]
                pairs += u.T @ (v / np.einsum("mi,mi->m", u @ model.move, v)[:, None])
        g = a[lo:hi] * beta
        g /= (g @ ones)[:, None]
        a[lo:hi] = g
        if t == 0:
            first = g[head].sum(0, dtype=np.float64)
    emit = np.stack([np.bincount(codes[tokens], a[:, s], len(model.emit)) for s in range(k)], 1)
    return Stats(first, pairs * model.move, emit, float(loglik.sum()))


def start_model(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """A first model: corpus-wide word shares times noise per state, and states that mostly stay."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 1.0, (len(share), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1.0 / states), move, emit / emit.sum(0))


def maximized(s: Stats, share: np.ndarray, prior: float = PRIOR, prior_move: float = PRIOR_MOVE) -> Model:
    """The model of the counts, with the corpus-wide shares as prior."""
    first = s.first + prior_move / len(s.first)
    move = s.move + prior_move / len(s.first)
    emit = s.emit + prior * share[:, None]
    return Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


# ---------------------------------------------------------------- the corpus


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all documents; each has one END. Equal words of a chunk are counted before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, words, _ in word_arrays(b.column(0), SPACED, fold=True, size=1 << 23):
                n = words.value_counts()
                yield pa.RecordBatch.from_arrays([n.field(0).cast(pa.string()), n.field(1)], ["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows], pa.int64())], ["word", "c"])

    return docs.select(text).mapInArrow(run, "word string, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Head words with their counts (END first), and what is known of the others."""

    words: list[str]
    counts: np.ndarray
    total: int       # tokens of the training documents
    distinct: int    # distinct tokens of the training documents
    least: int       # a word with this count and of at most WIDEST bytes is in the head

    @property
    def rest(self) -> int:
        """Sum of (c + 1) over the words outside the head, and 1 for unseen words (1 without training texts, when END is unseen too)."""
        return max(1, int(self.total + self.distinct + 1 - (self.counts + 1).sum()))

    @property
    def share(self) -> np.ndarray:
        """Corpus-wide probability of each head word and, last, of all others."""
        return np.append(self.counts + 1, self.rest) / (self.total + self.distinct + 1)


def _in_head(least: int):
    return (F.col("word") == END) | ((F.col("c") >= least) & (F.octet_length("word") <= WIDEST))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head of a counts table: at most ``head`` words and END are brought to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(LEAST, -(-total // head))
    got = counts.where(_in_head(least) & (F.col("word") != END)).orderBy(F.desc("c"), "word").collect()
    end = counts.where(F.col("word") == END).first()
    words, n = [END] + [r["word"] for r in got], [end["c"] if end else 0] + [r["c"] for r in got]
    return Vocabulary(words, np.array(n, np.int64), int(total), int(distinct), least)


def encode(docs: DataFrame, vocab: Vocabulary, text: str = "text", out: tuple[str, str, str] = ("codes", "other", "times")) -> DataFrame:
    """``docs`` without the text, with the codes of its words and END, its different words outside the head, and how often each comes.

    The code of a word outside the head is the size of the head. A null text counts as empty. Codes are packed as binary, which
    goes through Spark as one copy; ``unpacked`` gives them back.
    """
    rest = [c for c in docs.columns if c != text and c not in out]
    shared = docs.sparkSession.sparkContext.broadcast(vocab.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        for b in batches:
            for i, words, first in word_arrays(b.column(len(rest)), SPACED, fold=True, size=1 << 22):
                rows = len(first) - 1
                code = pc.fill_null(pc.index_in(words, known), len(known)).to_numpy(zero_copy_only=False)
                ends = first[1:] + np.arange(rows)
                codes = np.insert(code, first[1:], 0).astype(np.int32)
                stray = np.flatnonzero(code == len(known))
                names = words.take(pa.array(stray)).dictionary_encode()
                row = np.searchsorted(first, stray, "right") - 1
                key, times = np.unique((row << 32) | names.indices.to_numpy(zero_copy_only=False), return_counts=True)
                cuts = pa.array(np.searchsorted(key >> 32, np.arange(rows + 1)).astype(np.int32))
                other = names.dictionary.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string())
                lists = [packed(codes, np.append(0, ends + 1)),
                         pa.ListArray.from_arrays(cuts, other), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, rows) for c in range(len(rest))], *lists], [*rest, *out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*rest).schema)
    return docs.select(*rest, text).mapInArrow(run, f"{schema}`{out[0]}` binary, `{out[1]}` array<string>, `{out[2]}` array<int>")


def packed(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of codes below 2^24 as binary: the low 16 bits of each, then the high 8 bits of each (which compress to little)."""
    low, high = codes.astype("<u2").tobytes(), (codes >> 16).astype(np.uint8).tobytes()
    cuts = offsets.tolist()
    return pa.array([low[2 * a:2 * z] + high[a:z] for a, z in zip(cuts, cuts[1:])], pa.binary())


def unpacked(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed rows by batches of BATCH tokens or one row: first row, codes, offsets."""
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data, i = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
    while i < len(col):
        j = min(len(col), max(i + 1, int(np.searchsorted(ends, ends[i] + 3 * BATCH, "right")) - 1))
        off = (ends[i:j + 1] - ends[i]) // 3
        codes = np.empty(off[-1], np.int32)
        for r, (a, z) in enumerate(zip(off.tolist(), off[1:].tolist())):
            at, n = int(ends[i + r]), z - a
            codes[a:z] = np.frombuffer(data, "<u2", n, at)
            codes[a:z] |= data[at + 2 * n:at + 3 * n].astype(np.int32) << 16
        yield i, codes, off
        i = j


def baum_welch(encoded: DataFrame, model: Model, codes: str = "codes") -> Stats:
    """Expected counts of all rows: tasks add up their rows, Spark adds up the tasks; the driver gets one table of the model's size.

    State vectors are held in single precision here, counts in double; scores are computed in double.
    """
    spark, k = encoded.sparkSession, len(model.first)
    shared = spark.sparkContext.broadcast(model.single())

    def record(block: int, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells], pa.list_(pa.float64()))], ["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, tops), held = shared.value, None
        for b in batches:
            for _, c, off in unpacked(b.column(0)):
                s = expected_counts(m, c, off)
                s.loglik += float(tops[c].sum())
                s.move = s.move.astype(np.float64)
                if held is None:
                    held = s
                else:
                    held.first += s.first
                    held.move += s.move
                    held.emit += s.emit
                    held.loglik += s.loglik
        if held is None:
            return
        # block -1 holds the log probability, the first states and the moves, the others BLOCK codes each
        yield record(-1, np.concatenate([[held.loglik], held.first, held.move.ravel()]))
        for i in range(0, len(held.emit), BLOCK):
            yield record(i // BLOCK, held.emit[i:i + BLOCK].ravel())

    part = encoded.select(codes).mapInArrow(run, "block int, cells array<double>")
    total = part.groupBy("block").agg(Summarizer.sum(array_to_vector("cells")).alias("s"))
    out = Stats(np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape))
    for r in total.collect():  # one table of the model's size
        cells = r["s"].toArray()
        if r["block"] < 0:
            out.loglik, out.first, out.move = float(cells[0]), cells[1:k + 1], cells[k + 1:].reshape(k, k)
        else:
            out.emit[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = cells.reshape(-1, k)
    shared.unpersist()
    return out


def train(encoded: DataFrame, vocab: Vocabulary, key: str, *, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``encoded`` (the training documents), ``rounds`` times.

    The model that the first round starts from comes from a few cheap rounds over one in START_SHARE rows, drawn by a hash of
    ``key`` by the same rule at every size (where it draws none, the counts of no row leave the model as it is); the counts of every
    round over the corpus replace all of it. Without training rows every token is the one unseen word, with probability 1.
    """
    share = vocab.share
    model = start_model(share, states)
    if not vocab.total:
        return Model(model.first, model.move, np.repeat(share[:, None], states, 1))
    few = encoded.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(START_SHARE)) == 0)
    few = cut_lineage(few.select("codes").repartition(16), "start")
    for _ in range(START_ROUNDS):
        counts = baum_welch(few, model)
        if counts.first.any():
            model = maximized(counts, share)
    for _ in range(rounds):
        model = maximized(baum_welch(encoded, model), share)
    return model


def score(docs: DataFrame, training, text: str = "text", *, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score; ``training`` is a boolean column of it.

    base_score is the log10 probability under the word counts alone, (c + 1) / (N + V + 1) a token, score that under the hidden
    Markov model. Both are over whole texts; a null text counts as empty (one END). Rows where ``training`` is null do not
    train. Repeated rows are scored, and train, each by itself. Existing columns with the names of the results are replaced.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    row, learns = "__row", fresh(docs, "__learns")
    keys = [c for c in docs.columns if c not in made and c != text]
    flagged = docs.withColumn(learns, F.coalesce(training, F.lit(False))).select(*keys, learns, text)
    counts = cut_lineage(word_counts(flagged.where(learns), text), "words")
    vocab = vocabulary(counts)
    # the row number is written with the row, so that it stays the same whatever task is run again
    held = F.struct(*keys).alias("__keys")
    rows = cut_lineage(encode(flagged.select(held, learns, F.monotonically_increasing_id().alias(row), text), vocab, text), "encoded")
    model = train(rows.where(learns), vocab, row, states=states, rounds=rounds)

    # words outside the head: their counts, by a join on the word
    other = rows.where(F.size("other") > 0).select(row, F.explode(F.arrays_zip("other", "times")).alias("w")).select(
        row, F.col("w.other").alias("word"), F.col("w.times").alias("times"))
    found = other.join(counts.where(~_in_head(vocab.least)), "word").groupBy(row).agg(
        F.sum("times").alias("o_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("o_log"))

    shared = docs.sparkSession.sparkContext.broadcast((model, np.append(np.log10(vocab.counts + 1.0), 0.0), np.append(vocab.counts > 0, False)))
    width = len(vocab.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs, known = shared.value
        for b in batches:
            for i, c, off in unpacked(b.column(2)):
                parts = [np.diff(off), np.add.reduceat(known[c].astype(np.int64), off[:-1]), np.add.reduceat((c == width).astype(np.int64), off[:-1]),
                         np.add.reduceat(logs[c], off[:-1]), log_likelihood(m, c, off) / np.log(10.0)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(off) - 1), b.column(1).slice(i, len(off) - 1), *map(pa.array, parts)],
                                                 ["__keys", row, "n", "h_known", "strays", "h_log", "h_score"])

    kind = rows.select("__keys").schema[0].dataType.simpleString()
    head = rows.select("__keys", row, "codes").mapInArrow(run, f"__keys {kind}, {row} long, n long, h_known long, strays long, h_log double, h_score double")
    known, logs = (F.coalesce(c, F.lit(0)) for c in ("o_known", "o_log"))
    each = float(np.log10(vocab.total + vocab.distinct + 1))
    return head.join(found, row, "left").select(
        *[F.col("__keys").getField(c).alias(c) for c in keys], F.col("n").alias("n_tokens"), (F.col("h_known") + known).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("h_log") + logs - F.col("n") * F.lit(each)).alias("base_score"),
        (F.col("h_score") + logs - F.col("strays") * F.lit(float(np.log10(vocab.rest)))).alias("score"))
