"""The n-gram stage of the pipeline tells rows apart, not ids."""

import corpus_pipeline as cp


def test_rows_with_one_id_or_none(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("e")), (None, text("a")),
            (4, text("f")), (4, text("f")), (5, None), (5, None), (5, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in cp.one_of_each_group(spark, docs, "").collect()]
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (4, text("f")), (5, None), (5, ""), (None, None), (None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_only_texts_that_may_go_are_joined(spark, monkeypatch):
    """Of 300 texts two without words are sought as repetitions, and three rows are dropped; no other text enters a join."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(10))) for i in range(300)]
    rows += [(500, rows[5][1]), (501, rows[5][1]), (502, " "), (502, " ")]
    calls, marked = [], cp.jaccard.marked

    def counted(d, wanted, flag, key="id"):
        out = marked(d, wanted, flag, key)
        if key == cp._ROW:
            calls.append((out.count(), out.where(flag).count()))
        return out

    monkeypatch.setattr(cp.jaccard, "marked", counted)
    got = [tuple(r) for r in cp.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got) == [*rows[:300], (502, " ")]
    assert calls == [(304, 2), (304, 3)]


def test_each_text_goes_to_python_once_before_decontamination(spark, sf, monkeypatch):
    """No struct of the whole row goes beside the text, and columns named as those that find() adds keep their values."""
    frames, arrow_map = [], cp.decontam.arrow_map
    monkeypatch.setattr(cp.decontam, "arrow_map", lambda frame, *a: frames.append(frame.dtypes) or arrow_map(frame, *a))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) >= 20").first()["text"]
    docs = spark.createDataFrame([(1, "a few clean words", "x"), (2, item, "y"), (3, None, "z")], "doc_id long, text string, hits string")
    got = cp.no_benchmark(spark, docs, sf)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a few clean words", "x"), (3, None, "z")]
    assert [kind for _, kind in frames[0]] == ["bigint", "string", "string"]


def test_batches_of_long_texts_are_bounded(spark, sf):
    """2000 texts of 8 kB leave in batches of some MB (16 MB at once before); a bound of the user's stays."""
    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat('few words ', 800) AS text")
    sizes = lambda d: [r["n"] for r in d.mapInArrow(_batch_bytes, "n long").collect()]
    old = spark.conf.get(cp.BATCH, None)
    try:
        spark.conf.unset(cp.BATCH)
        cp.no_benchmark(spark, docs, sf)
        assert max(sizes(docs)) < 2 * cp.BATCH_BYTES < sum(sizes(docs))
        spark.conf.set(cp.BATCH, "1000000")
        cp.no_benchmark(spark, docs, sf)
        assert spark.conf.get(cp.BATCH) == "1000000"
    finally:
        spark.conf.set(cp.BATCH, old) if old else spark.conf.unset(cp.BATCH)


def _batch_bytes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])
