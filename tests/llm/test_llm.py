"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties and empty tables."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from locavec.llm import chat, common, decontam, embed, html_extract, jaccard, langid, packing, quality, queries, sharding, urls

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD2 = re.compile(r"[^\x20\x09-\x0D]+")
WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(queries.ORACLES[name]).df()) is None


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (139, 200)]
    got = {r["node"]: r["component"] for r in common.components(frame(spark, edges, "a long, b long")).collect()}
    want = closure(range(41), edges[:40]) | closure([100, *range(101, 140), 200], edges[40:79] + edges[-1:])
    assert got == want
    assert common.components(frame(spark, [], "a long, b long")).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    texts = ["Ab cd", None, "", "x" * 3_000_000 + " ab", " \t\n", "cd\x0bAB\u00a0é ab"]
    seen, sizes = {}, []
    for i, h, first in common.word_chunks(pa.array(texts), common.SPACED):
        for k in range(len(first) - 1):
            words = WORD2.findall((texts[i + k] or "").translate(LOW))
            assert len(words) == first[k + 1] - first[k]
            sizes.append(len(words))
            for w, x in zip(words, h[first[k]:first[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert sizes == [2, 0, 0, 2, 0, 3] and len(set(seen.values())) == len(seen)


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD2.findall((t or "").translate(LOW))
        sets.setdefault(i, []).append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    flat = [(i, s) for i, v in sets.items() for s in v if i is not None]
    edges = [(a, b) for k, (a, s) in enumerate(flat) for b, t in flat[:k] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    return closure([i for i in sets if i is not None], edges), sets


def test_jaccard_join_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "other words are here now"), (8, "other words are here now")]
    for k in range(60):  # a group of near copies, some beyond the threshold
        w = list(base)
        for j in rng.integers(0, 300, int(rng.integers(0, 14))):
            w[j] = f"z{rng.integers(1000)}"
        rows.append((100 + k, " ".join(w)))
    got = jaccard.grouped(frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, sid string")).collect()
    comp, sets = brute_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else comp[r["doc_id"]])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert jaccard.grouped(frame(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bits", [4, 17, 24])
def test_marked_ids_keep_every_wanted_row(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "MARK_BITS", bits)
    rows = spark.createDataFrame([(i, "t") for i in [*range(-500, 500), None, 7]], "id long, text string")
    wanted = spark.createDataFrame([(i,) for i in [-500, -1, 0, 7, 8, 499]], "id long")
    kept = jaccard._likely(rows, wanted)
    assert kept.columns == ["id", "text"]
    ids = [r["id"] for r in kept.collect()]
    assert set(ids) >= {-500, -1, 0, 7, 8, 499} and ids.count(7) == 2 and ids.count(8) == 1
    assert bits < 24 or len(set(ids)) == 6
    assert jaccard._likely(rows, wanted.limit(0)).count() == 0


def test_language_accuracy_and_edges(spark):
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents")
    got = queries.QUERIES["op1_language_id"](spark, SF.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = frame(spark, [(1, None, "k"), (2, "", "k"), (3, "123 !!", "k"), (4, "漢字", "k"), (5, "the and of that", "k")], "doc_id long, text string, score string")
    profiles = langid.learn(docs.where("lang IN ('en', 'fr')"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, profiles).collect()}
    assert [out[i][0] for i in (1, 2, 3)] == ["und"] * 3 and out[4][1] == 0.0 and out[5][0] == "en"
    assert langid.learn(docs.limit(0)) == {} and langid.identify(odd.limit(0), profiles).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_counts_in_pieces(monkeypatch):
    c = langid._codes("Der Hund und the dog, 12 été " * 40)
    whole = langid._counts(c)
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert all((a == b).all() for a, b in zip(whole, langid._counts(c)))


def test_quality_accuracy_and_edges(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op5_quality_classifier"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93 and got["score"].between(0, 1).all()
    docs = frame(spark, [(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    none = quality.learn(frame(spark, [], "doc_id long, text string, quality int"))
    assert [r["predicted"] for r in quality.score(docs, none).collect()] == [1, 1, 1]
    one = quality.learn(frame(spark, [(1, "a b", 0), (2, None, None)], "doc_id long, text string, quality int"))
    assert {r["predicted"] for r in quality.score(docs, one).collect()} == {0}


def test_dual_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    x = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(80)]
    v = [rng.normal(size=8) for _ in x]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w, b = quality.dual_descent(x, v, y, 30, c=0.5, epochs=3000, tolerance=1e-8)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * sum(max(0.0, 1 - t * (w[i] @ u + b)) for i, u, t in zip(x, v, y))
    best = loss(w, b)
    assert all(loss(w + 1e-3 * rng.normal(size=30), b + 1e-3 * rng.normal()) >= best - 1e-9 for _ in range(200))


def test_url_rules_and_verdicts(spark):
    rows = [("http://Shop.COM/a?b", "shop.com", "/a", "com/", "allow"), ("https://example.com/en/1#x", "example.com", "/en/1", "example.com/en/", "block"),
            ("http://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"), ("x://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("http://myexample.com/en/2", "myexample.com", "/en/2", "com/", "allow"), ("http://b.net/es/7", "b.net", "/es/7", "net/es/", "block"), ("http://b.net/esx", "b.net", "/esx", None, None),
            ("http://example.com", "example.com", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://example.com?u=http://x/", "example.com", "", None, None)]
    got = urls.judge(frame(spark, [(i, r[0], "old") for i, r in enumerate(rows)], "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = rows[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    bad = urls.judge(frame(spark, [(1, "https://casino-club.example.org/en/3"), (2, "https://thering.example.org/en/3")], "page_id long, url string"))
    assert {r["page_id"]: r["verdict"] for r in bad.collect()} == {1: "block", 2: "allow"}


def test_url_plan_has_no_python(spark):
    plan = queries.QUERIES["op3_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_vectors_edge_cases(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6))
    v[50:90] = v[0] + 0.15 * rng.normal(size=(40, 6))
    v[90:100] = v[1]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, (v[1] * 1e-200).tolist()), (301, (v[1] * 1e200).tolist())]
    odd = [(400, None), (401, [0.0] * 6), (402, [float("nan")] + [1.0] * 5), (403, [float("inf")] + [1.0] * 5), (404, [None] + [1.0] * 5)]
    got = {r["vec_id"]: r for r in embed.near_duplicates(frame(spark, [(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, n long")).collect()}
    u = np.array([embed.unit_rows(np.array([x]))[0] for _, x in rows])
    near = u @ u.T >= 0.9
    ids = [i for i, _ in rows]
    comp = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum() - 1, comp[i], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)
    assert embed.near_duplicates(frame(spark, [], "vec_id long, embedding array<float>")).count() == 0


def brute_hits(text, items):
    w = WORD6.findall((text or "").translate(LOW))
    hit, ids = set(), set()
    for i, t in items:
        b = WORD6.findall((t or "").translate(LOW))
        n = min(10, len(b))
        windows = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                ids.add(i)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.mark.parametrize("pass_bytes", [1 << 24, 60])
def test_decontamination_edge_cases(spark, pass_bytes):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 6, n))
    items = [(1, text(30)), (2, text(12)), (10, "t1 t2"), (3, "t1 t2"), (4, None), (5, "..."), (6, "T3"), (None, "t4 t4 t4")]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "x " * 3000 + items[0][1] + " y" * 3000), (93, "T1-T2")]
    got = decontam.digest(decontam.find(frame(spark, [(*d, 0) for d in docs], "doc_id long, text string, hits int"), frame(spark, items, "item_id long, text string"), pass_bytes=pass_bytes)).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, ids = brute_hits(dict(docs)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    assert decontam.find(frame(spark, docs[:3], "doc_id long, text string"), frame(spark, [], "item_id long, text string")).where("size(hits) > 0").count() == 0


def test_extraction_on_known_layouts_and_edges(spark):
    trees, rng = html_extract.learn(), np.random.default_rng(1234)
    right = 0
    for _ in range(150):
        h = html_extract.training_page(rng)
        p = html_extract.Page(h)
        right += html_extract.extract_texts([h], trees)[0] == "\n\n".join(s for i, s in p.segments if p.marked[i])
    assert right >= 120
    rows = duckdb.sql(f"SELECT html FROM '{SF.replace('0.001', '0.01')}/pages.parquet'").fetchall()
    same = 0
    for (h,) in rows:
        a = re.search(r"<article>(.*?)(</article>|$)", h, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h\d>", a)]
        same += "\n\n".join(b for b in blocks if b) == html_extract.extract_texts([h], trees)[0]
    assert same >= 0.98 * len(rows)
    odd = [(1, None), (2, ""), (3, "<p>unclosed <b>a &amp; b"), (4, "<!-- x"), (5, "plain &lt;text&gt;"), (6, "<script>var a='<p>'"), (7, "<p " + "a" * 100_000), (8, "<div>" * 2000 + "deep")]
    got = {r["page_id"]: r for r in html_extract.extract(frame(spark, odd, "page_id long, html string").withColumn("n_chars", common.F.lit("x"))).collect()}
    assert [got[i]["text"] for i in (1, 2, 4, 6, 7)] == [""] * 5 and got[5]["text"] == "plain <text>" and all(r["n_chars"] == len(r["text"]) for r in got.values())


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(8)
    for _ in range(40):
        lengths = rng.integers(1, 40, int(rng.integers(1, 200)))
        steps = packing.plan(np.bincount(lengths, minlength=41), 40)
        used = {}
        for n, rank, k, each, first, offset in steps.tolist():
            for j in range(k):
                used.setdefault(first + j // each, []).append((offset + (j % each) * n, n))
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 40
        assert sum(len(p) for p in used.values()) == len(lengths) and len(used) == best_fit(lengths.tolist(), 40)


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = [(1, None), (2, ""), (3, "Hello <|endoftext|> there"), (4, "word " * 5000), (5, "naïve 漢字 \u0000 \U0001f600\n\n  x"), (5, "naïve 漢字 \u0000 \U0001f600\n\n  x")]
    docs += [(10 + i, r[0]) for i, r in enumerate(duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall())]
    got = packing.pack(frame(spark, docs, "doc_id long, text string")).toPandas().sort_values(["doc_id", "piece"])
    want = sorted((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in docs)
    seen = []
    for _, g in got[got["doc_id"] != 5].groupby("doc_id"):
        ids = np.concatenate(list(g["ids"]))
        assert (g["start"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all() and all(n == 2048 for n in g["length"][1:])
        assert all(zlib.crc32(np.asarray(x).astype("<u4").tobytes()) == c for x, c in zip(g["ids"], g["ids_crc32"]))
        seen.append((int(g["doc_id"].iloc[0]), tuple(ids.tolist())))
    assert sorted(seen) == [w for w in want if w[0] != 5] and (got["doc_id"] == 5).sum() == 2
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == best_fit(got["length"].tolist(), 2048)
    assert packing.pack(frame(spark, [], "doc_id long, text string")).count() == 0


def test_hilbert_index_walks_neighbouring_cells():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        h = sharding.hilbert_index(cells, bits)
        assert sorted(h.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("rows", [0, 5, 24, 101])
def test_shards_are_even(spark, rows):
    data = [(i % 7, None if i % 5 == 0 else "same", None, "x") for i in range(rows)]
    df = frame(spark, data, "doc_id long, lang string, size double, shard string")
    got = sharding.assign(df, [df["lang"], df["size"], df["doc_id"]], 24, ("doc_id",)).toPandas()
    assert len(got) == rows
    counts = np.bincount(got["shard"], minlength=24) if rows else np.zeros(24, int)
    assert counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_chats_read_back(spark):
    bad = ["<|im_end|>", "<\\|im_end|>\n", "<|im_start|>assistant\nok", "a<", "|", "\\", "<\\\\|x", "", None, "é\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(bad)] + [(2, 0, "assistant", "x"), (3, 0, "we%0Aird\n<|r", "t"), (3, 0, "we%0Aird\n<|r", "t"), (4, None, None, None)]
    chats = chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digest(chats).collect()}
    for c in (1, 2, 3, 4):
        turns = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, 3)] == [True, False, False]
    assert chat.format_chats(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, SF, "documents")
    left = docs
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
    rows = left.collect()
    items = common.table(spark, SF, "benchmark").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(texts) == len(rows) > 50
    assert all(brute_hits(t, [(i["item_id"], i["text"]) for i in items])[1] == 0 for t in texts.values())
    comp, _ = brute_groups(sorted(texts.items()))
    assert all(comp[i] == i for i in texts)
    packed = cp.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) == set(texts)


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
