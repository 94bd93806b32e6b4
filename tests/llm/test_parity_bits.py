"""Sets are rebuilt only for pairs that their parity bits allow to be linked."""

import random

import numpy as np

from locavec.llm import jaccard


def test_bits_never_refuse_a_linked_pair(spark):
    """Sizes around powers of two and thresholds that put the sizes of a linked pair several powers apart."""
    rng = np.random.default_rng(2)
    sets, pairs = [np.zeros(1, np.uint64)], []
    for n in (1, 2, 40, 63, 64, 65, 120, 128, 130, 511, 513, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.02, 0.07, 0.09, 0.2, 0.5, 0.9):
            b = np.unique(np.concatenate([a[int(share * n):], rng.integers(0, 1 << 63, int(rng.integers(0, share * n + 1)), dtype=np.uint64)]))
            pairs.append((len(sets), len(sets) + 1, len(np.intersect1d(a, b))))
            sets += [a, b]
    marks = spark.createDataFrame([(i, len(s), jaccard.parity(s).tolist()) for i, s in enumerate(sets)], "sid long, n long, w array<long>")
    asked = spark.createDataFrame([(x, y) for x, y, _ in pairs], "x long, y long")
    for percent in (10, 40, 85):
        kept = {tuple(r) for r in jaccard.near(asked, marks, percent).collect()}
        linked = {(x, y) for x, y, o in pairs if 100 * o >= percent * (len(sets[x]) + len(sets[y]) - o)}
        assert linked and linked <= kept
    assert len(kept) < len(pairs)


def test_texts_that_share_a_sentence_are_not_rebuilt(spark, monkeypatch):
    """Each of 60 texts shares a rare sentence with the next; two more are near copies."""
    rng = random.Random(1)
    own = [[f"d{i}w{j}" for j in range(150)] for i in range(60)]
    rows = [(i, " ".join([*(f"s{i}v{j}" for j in range(8)), *own[i], *(f"s{i + 1}v{j}" for j in range(8))])) for i in range(60)]
    copy = rows[3][1].split()
    copy[rng.randrange(20, 140)] = "other"
    rows.append((100, " ".join(copy)))
    asked, overlaps = [], jaccard._overlaps

    def counted(r, same, pairs, words, name):
        asked.append(pairs.count())
        return overlaps(r, same, pairs, words, name)

    monkeypatch.setattr(jaccard, "_overlaps", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 100 else i for i, _ in rows}
    assert sum(asked) <= 2  # 60 and more without the bits
