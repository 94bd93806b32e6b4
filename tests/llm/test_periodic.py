"""Periodic runs against a search over all lags."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from locavec.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, repeats=3):
    got = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, repeats * q) and not any(w[s + d:s + n] == w[s:s + n - d] for d in range(1, q)):
                got.append((s, n, q))
            i += i == s
    return sorted(got)


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(rng):
    out = []
    for _ in range(rng.integers(0, 6)):
        base = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 40))).tolist()
        out += [base[x % len(base)] for x in range(int(rng.integers(0, 4 * len(base) + 10)))]
        out += rng.integers(0, 4, rng.integers(0, 20)).tolist() if rng.random() < 0.5 else []
    return out


@pytest.mark.parametrize("least,repeats", [(24, 3), (10, 3), (7, 4)])
def test_runs_of_random_periodic_rows(least, repeats):
    rng = np.random.default_rng(least)
    for _ in range(150):
        rows = [periodic_words(rng) for _ in range(rng.integers(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        got = periodic.find_runs(np.array(sum(rows, []), np.int64), first, least, repeats)
        assert [tuple(x) for x in got.tolist()] == [(k, *x) for k, r in enumerate(rows) for x in brute(r, least, repeats)]


def test_long_rows_take_one_pair_a_word():
    n = 300_000
    assert periodic.find_runs(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, 0, n, 1]]
    assert periodic.find_runs(np.arange(n) % 70_001, np.array([0, n])).tolist() == [[0, 0, n, 70_001]]
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.int64), np.array([0, 3]), min_repeats=2)


def test_texts_with_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", " \t\n", "a b " * 12, "a b " * 12, "x " + "Q é  " * 30 + "y", "one two three", "z" * 500_000 + " k" * 100_000]
    rows = [(None if i == 4 else i, t, "old", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, __h int")
    got = sorted(periodic.detect(periodic.plant(docs.where("doc_id < 0 OR doc_id IS NULL OR doc_id >= 0"), "doc_id")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "__h", "n_words", "runs", "collapsed"}
    for r in got:
        w = WORD.findall(r["text"] or "")
        runs = [tuple(x) for x in r["runs"]]
        assert r["n_words"] == len(w)
        if len(w) < 1000:
            assert runs == brute(w) and r["collapsed"] == collapsed(w, runs)
    assert [tuple(x) for x in got[6]["runs"]] == [(1, 100_000, 1)]
    empty = periodic.detect(periodic.plant(docs.limit(0)))
    assert empty.count() == 0


def test_planted_ends_and_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    planted = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect():
        w, h = WORD.findall(docs[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n, planted = h // 10, len(w), planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5
