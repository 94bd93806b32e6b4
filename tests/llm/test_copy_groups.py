"""Large groups of changed copies: one class in one round, whatever the number of pairs that are nearly linked."""

import random

from locavec.llm import jaccard


def test_copies_with_changes_meet_their_middle_first(spark, monkeypatch):
    """150 copies with three words replaced are linked with the text in their middle, and hardly any of them with one another."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows.insert(70, (1000, " ".join(base)))
    rows += [(2000 + i, " ".join(f"z{i}v{j}" for j in range(50))) for i in range(20)]
    counts, pairs_of = [], jaccard.index_pairs

    def counted(*a):
        pairs = pairs_of(*a)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "index_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i >= 2000 else 0 for i, _ in rows}
    assert counts[0] < 151  # 11280 when the first leader is any of the copies
