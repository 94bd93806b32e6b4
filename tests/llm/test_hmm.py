"""The hidden Markov model against recursions word by word, and its scores against plain counts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locavec.llm import hmm, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_model(rng, states, codes):
    r = lambda *s: rng.random(s) + 0.05
    first, move, emit = r(states), r(states, states), r(codes, states)
    return hmm.Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def naive(m, c):
    a, b = np.zeros((len(c), len(m.first))), np.ones((len(c), len(m.first)))
    a[0] = m.first * m.emit[c[0]]
    for t in range(1, len(c)):
        a[t] = a[t - 1] @ m.move * m.emit[c[t]]
    for t in range(len(c) - 2, -1, -1):
        b[t] = m.move @ (m.emit[c[t + 1]] * b[t + 1])
    total = a[-1].sum()
    pairs = sum((np.outer(a[t], m.emit[c[t + 1]] * b[t + 1]) * m.move / total for t in range(len(c) - 1)), np.zeros_like(m.move))
    return math.log(total), a * b / total, pairs


@pytest.mark.parametrize("size", [1, 3, 7, 512])
def test_counts_and_probabilities_whatever_the_segments(size, monkeypatch):
    monkeypatch.setattr(hmm.Segments.__init__, "__defaults__", (size,))
    rng = np.random.default_rng(size)
    for _ in range(20):
        codes = int(rng.integers(2, 9))
        m = random_model(rng, int(rng.integers(1, 5)), codes)
        off = np.concatenate([[0], np.cumsum(rng.integers(1, 40, rng.integers(1, 9)))])
        c = rng.integers(0, codes, off[-1])
        s, each = hmm.expected_counts(m, c, off, size), hmm.log_likelihood(m, c, off)
        first, move, emit = np.zeros_like(s.first), np.zeros_like(s.move), np.zeros_like(s.emit)
        for i, (a, z) in enumerate(zip(off, off[1:])):
            total, g, pairs = naive(m, c[a:z])
            assert each[i] == pytest.approx(total, rel=1e-9)
            first, move = first + g[0], move + pairs
            np.add.at(emit, c[a:z], g)
        assert np.allclose(s.first, first) and np.allclose(s.move, move) and np.allclose(s.emit, emit)


def test_single_precision_counts_of_rare_words_and_long_rows():
    """Emissions far below the range of single precision, and rows of many segments."""
    rng = np.random.default_rng(9)
    m = random_model(rng, 4, 50)
    m = hmm.Model(m.first, m.move, m.emit * np.logspace(0, -30, 50)[:, None])
    off = np.concatenate([[0], np.cumsum([5000, 1, 700, 30])])
    c = rng.integers(0, 50, off[-1])
    one, tops = m.single()
    a, b = hmm.expected_counts(one, c, off), hmm.expected_counts(m, c, off)
    assert one.emit.dtype == np.float32 and np.allclose(a.emit, b.emit, atol=1e-3) and np.allclose(a.move, b.move, rtol=1e-4)
    assert a.loglik + tops[c].sum() == pytest.approx(b.loglik, rel=1e-6) and a.emit.sum() == pytest.approx(len(c), rel=1e-6)


def test_all_texts_of_a_length_add_up_to_one():
    m = random_model(np.random.default_rng(2), 3, 4)
    texts = np.array(list(itertools.product(range(4), repeat=5)))
    each = hmm.log_likelihood(m, texts.ravel(), np.arange(len(texts) + 1) * 5)
    assert np.exp(each).sum() == pytest.approx(1)


def test_rounds_never_lower_the_likelihood_of_the_penalized_model():
    rng = np.random.default_rng(4)
    c, off = rng.integers(0, 12, 4000), np.arange(0, 4001, 40)
    share = np.full(12, 1 / 12)
    m, seen = hmm.start_model(share, 3), []
    for _ in range(8):
        s = hmm.expected_counts(m, c, off)
        prior = hmm.PRIOR * (share[:, None] * np.log(m.emit)).sum() + hmm.PRIOR_MOVE / 3 * (np.log(m.move).sum() + np.log(m.first).sum())
        seen.append(s.loglik + prior)
        m = hmm.maximized(s, share)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_packed_codes_come_back():
    rng = np.random.default_rng(6)
    n = np.array([1, 5, 0, 300_000, 2])
    off = np.concatenate([[0], np.cumsum(n)])
    c = rng.integers(0, 1 << 24, off[-1]).astype(np.int32)
    got = [(i, x, o) for i, x, o in hmm.unpacked(hmm.packed(c, off))]
    assert np.array_equal(np.concatenate([x for _, x, _ in got]), c)
    assert np.array_equal(np.concatenate([np.diff(o) for _, _, o in got]), n)
    assert [x.tolist() for _, x, _ in hmm.unpacked(hmm.packed(c, off).slice(4))] == [c[-2:].tolist()]


def counts(rows):
    tokens = [WORD.findall((t or "").translate(LOW)) + [hmm.END] for _, t, _ in rows]
    c = Counter(w for x, (_, _, held) in zip(tokens, rows) if not held for w in x)
    n, v = sum(c.values()), len(c)
    return [(len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for x in tokens]


def assert_base(got, rows):
    want = sorted((i, h, *x) for (i, _, h), x in zip(rows, counts(rows)))
    have = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want])


def test_query_counts_exactly_and_beats_them_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs]
    got = queries.QUERIES["op13_lm_scoring"](spark, SF).collect()
    assert_base(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_score_is_the_product_of_head_model_and_shares(spark, monkeypatch):
    """The score against a word by word recursion over the operator's own model; a rare word takes its share of the class."""
    seen = {}
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda e, v, k, **o: seen.setdefault("m", (train(e, v, k, **o), v))[0])
    rows = [(i, t, held) for i, (t, held) in enumerate([
        ("a b a b c a", False), ("B a b a a rare", False), (None, False), ("a unseen b rare", True), ("", True), ("b a " * 700, False)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in hmm.score(docs, ~F.col("held_out"), states=2, rounds=2).collect()}
    assert_base(got.values(), rows)
    m, v = seen["m"]
    n = Counter(w for _, t, held in rows if not held for w in WORD.findall((t or "").translate(LOW)))
    assert v.words == [hmm.END, "b", "a"] or v.words == [hmm.END, "a", "b"]
    assert v.share.sum() == pytest.approx(1)
    for i, t, _ in rows:
        words = WORD.findall((t or "").translate(LOW)) + [hmm.END]
        a, log = m.first, 0.0
        for k, w in enumerate(words):
            a = (a if k == 0 else a @ m.move) * m.emit[v.words.index(w) if w in v.words else len(v.words)]
            log += math.log10(a.sum()) + (0 if w in v.words else math.log10((n[w] + 1) / v.rest))
            a = a / a.sum()
        assert got[i]["score"] == pytest.approx(log)


def test_empty_tables_nulls_repeats_and_clashing_names(spark):
    ddl = "doc_id long, text string, held_out boolean, score string, codes int, other int"
    assert hmm.score(spark.createDataFrame([], ddl), ~F.col("held_out")).count() == 0
    only = hmm.score(spark.createDataFrame([(1, "a b", True, "x", 1, 2)], ddl), ~F.col("held_out")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in only] == [(3, 0, 0, 0.0, 0.0)]
    rows = [(1, "a b", False), (1, "a b", False), (2, None, False), (3, "x" * 400 + " a " * 90_000, False), (4, "x" * 400, True)]
    got = hmm.score(spark.createDataFrame([(*r, "s", 1, 2) for r in rows] + [(None, "a", None, None, None, None)], ddl), ~F.col("held_out")).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) for r in got)
    assert_base([r for r in got if r["doc_id"] is not None], rows)
    assert {"codes", "other"} <= set(got[0].asDict())


def test_the_start_is_drawn_by_one_rule_at_every_size(spark, monkeypatch):
    """Rows of the first rounds: the same share by hash of a small corpus and of one with many more tokens."""
    seen, run = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda e, m, *a: seen.append(e.count()) or run(e, m, *a))
    monkeypatch.setattr(hmm, "START_ROUNDS", 1)
    for words in (3, 3000):  # 3000 and 3 million tokens
        docs = spark.range(1000).select("id", F.repeat(F.lit("a b "), words // 2).alias("text"), F.lit(True).alias("t"))
        hmm.score(docs.repartition(1).sortWithinPartitions("id"), F.col("t"), states=2, rounds=1).count()
    assert seen[0] == seen[2] < 60 and seen[1] == seen[3] == 1000  # before: 1000 rows of the small one
