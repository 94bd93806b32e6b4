"""Set-similarity join on word n-grams, with skipping by index blocks and by answers of similar sets.

Two sets are linked when 100 * |A and B| >= percent * |A or B|; the result is exact.

1. Equal sets are one set from here on; copies take the group of their representative at the very end.
2. *Index.* Each set's n-grams are put in one order (frequency estimate, then hash, rare first), and only a prefix
   is indexed, since linked sets share an n-gram there. The lists are cut into blocks of set sizes. An entry at
   position i of a set of n can be the first common n-gram only with partners of at most
   (n - i) * (100 + percent) / percent - n elements, so that its probe visits just the blocks up to this size, and none from about
   the middle of the prefix on. Lists of a single set are dropped.
3. *Leaders.* In rounds, each block of a list names a leader (first the set with the fewest rarer n-grams, then the least by a hash), and each set is compared with the leader
   that it meets in most lists. Linked sets become one class and keep their overlap with the leader; members of a class do not meet
   again, and lists of a single class are dropped. A round forms at most one pair a set, so a large group of near copies closes in
   linear work. Rounds go on while they link at least one in fifty of the sets still listed; what they miss is found in the next step.
   Before sets are rebuilt for a pair, here and in step 4, it must pass its parity bits: each set has about as many bits as elements, an element
   flips one of them, so that the bits in which two sets differ are at most the elements in which they do. Unrelated sets differ in about half.
4. *Answers.* The index gives all pairs of sets of different classes. Those of the leaders are counted first. The overlap of a member with
   a partner then lies between o(leader, partner) - |leader - member| and o(leader, partner) + |member - leader|; only pairs that these
   bounds leave open are counted themselves.

The order needs no exact frequencies: any order gives the same links, a good one short lists. The estimate is a hashed count
over all documents. Sets are rebuilt from the texts of the documents in some pair, so no table of all sets is kept.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch, shared_dir
from .common import SPACED, arrow_map, components, mix, ngram_hashes, word_chunks

#: Words in an n-gram, and counters of the frequency estimate.
WORDS, SKETCH_BITS = 4, 24
#: A round of leaders is followed by another if it links at least one in so many of the listed sets.
SETTLED = 50
#: Bits of the bitmap of wanted documents; more bits let fewer others into the shuffle.
MARK_BITS = 24
#: Bytes of text that are hashed at once, and rows whose sets a worker holds at once: they bound its memory, not the result.
CHUNK_BYTES, HELD_ROWS = 1 << 18, 1024


def sets_of(col: pa.Array, words: int):
    """Sorted distinct n-gram hashes of each text: n-grams of ``words`` words, or the whole shorter text as one."""
    with np.errstate(over="ignore"):
        for _, h, first in word_chunks(col, SPACED, CHUNK_BYTES):
            g = ngram_hashes(h, words)
            for a, z in zip(first[:-1], first[1:]):
                if z - a >= words:
                    yield np.unique(g[a:z - words + 1])
                else:
                    yield ngram_hashes(h[a:z], z - a) + np.uint64(z - a) if z > a else g[:0]


def _sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Hashed counts of the n-grams over all texts (each text's set counts once), in eighths of a power of two."""
    blocks, width = 32, 1 << bits
    # two levels of sums, each over about the root of the number of parts
    salts = max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def count(batches):
        from pyspark import TaskContext

        c = np.zeros(width, np.int32)
        for b in batches:
            held, n = [], 0
            for s in sets_of(b.column(0), words):
                held.append((s >> np.uint64(64 - bits)).astype(np.int64))
                n += len(s)
                if n > 1 << 18:
                    np.add.at(c, np.concatenate(held), 1)
                    held, n = [], 0
            if held:
                np.add.at(c, np.concatenate(held), 1)
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([salt] * blocks, pa.int32()),
                                          pa.array([_packed(x) for x in np.split(c, blocks)], pa.binary())], ["block", "salt", "c"])

    def add(frame):
        total = sum(_unpacked(x) for x in frame["c"])
        frame = frame.iloc[:1].copy()
        frame["c"] = [_packed(total)]
        return frame

    schema = "block int, salt int, c binary"
    part = docs.select("text").mapInArrow(count, schema)
    part = part.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    out = np.zeros((blocks, width // blocks), np.uint8)
    for r in part.collect():  # as many numbers as the sketch has
        out[r["block"]] = np.minimum(255, np.round(8 * np.log2(1.0 + _unpacked(r["c"]))))
    return out.ravel()


def _packed(c: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, compressed."""
    kind = np.uint8 if c.max(initial=0) < 256 else np.uint32 if c.max(initial=0) < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(c.astype(kind).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), {1: np.uint8, 4: np.uint32, 8: np.int64}[x[0]]).astype(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return (int(mix(s + np.uint64(5)).sum(dtype=np.uint64).astype(np.int64)),
                int((mix(s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)).sum(dtype=np.uint64).astype(np.int64)))


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set, in words of 64: bit h modulo their number is set if an odd number of elements have it. Their number is the next power of two."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _summaries(rows: DataFrame, estimate: np.ndarray, words: int, percent: int, bits: int) -> DataFrame:
    """Per text: size, digest and parity bits of the set, and the ordered prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(estimate)

    def run(b):
        n, d, w, prefix = [], [], [], []
        for s in sets_of(b.column(1), words):
            n.append(len(s))
            d.append(_digest(s))
            w.append(parity(s))
            order = np.lexsort((s, shared.value[(s >> np.uint64(64 - bits)).astype(np.int64)]))
            prefix.append(s[order[:len(s) - (percent * len(s) + 99) // 100 + 1]].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()),
             pa.array(w, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "d1", "d2", "w", "prefix"])

    return arrow_map(rows, run, "id long, n long, d1 long, d2 long, w array<long>, prefix array<long>", HELD_ROWS)


def _written(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written; the cuts that it makes on the way are removed at once."""
    path = shared_dir(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def linked(overlap: Column, n1: Column, n2: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def differing(w1: Column, w2: Column) -> Column:
    """Number of differing parity bits, at most the size of the symmetric difference; the longer bits are folded to the length of the shorter."""
    least = F.least(F.size(w1), F.size(w2))

    def folded(w: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(w), least), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.element_at(w, j)))

    return F.aggregate(F.sequence(F.lit(1), least), F.lit(0).cast("long"), lambda a, i: a + F.bit_count(folded(w1, i).bitwiseXOR(folded(w2, i))))


def near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that their sizes and parity bits in ``marks`` (sid, n, w) allow to be linked: all linked ones, and few others."""
    for side in ("x", "y"):
        pairs = pairs.join(marks.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("w").alias(f"w{side}")), side)
    most = F.shiftright(F.col("nx") + F.col("ny") - differing(F.col("wx"), F.col("wy")), 1)
    return pairs.where(linked(most, F.col("nx"), F.col("ny"), percent)).select("x", "y")


def marked(rows: DataFrame, wanted: DataFrame, flag: str, key: str = "id") -> DataFrame:
    """``rows`` with a boolean column: true if the key is among those of ``wanted``, and for some others, without a shuffle of the texts.

    The keys are hashed into a bitmap of ``2 ** MARK_BITS`` bits, whatever their number: that bounds the broadcast side (2 MB).
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))
    marks = wanted.select(h.alias("h")).distinct().groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__marks"))
    at = F.bitmap_bit_position(h)
    octet = F.conv(F.hex(F.substring("__marks", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(h)).join(F.broadcast(marks), "__bucket", "left")
            .select(*rows.columns, F.coalesce(octet.bitwiseAND(bit) != 0, F.lit(False)).alias(flag)))


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is among the ids of ``wanted``, and some others."""
    return marked(rows, wanted, "__likely").where("__likely").drop("__likely")


def _overlaps(rows: DataFrame, same: DataFrame, pairs: DataFrame, words: int, name: str) -> DataFrame:
    """``pairs`` of set numbers (x, y) with both sizes and the size o of the intersection.

    The sets are rebuilt from the texts of the documents that stand for them.
    """
    pairs = cut_lineage(pairs, name)
    need = pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct().join(same.select("sid", F.col("rep").alias("id"), "d1", "d2"), "sid")

    def run(b):
        s = list(sets_of(b.column(1), words))
        d = [_digest(x) for x in s]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()),
             pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], ["id", "d1", "d2", "s"])

    need = cut_lineage(need, name)
    # texts stay where they are; repeated rows fall together before the shuffle, and the join keeps its partitioning
    sets = (arrow_map(_likely(rows, need), run, "id long, d1 long, d2 long, s array<long>", HELD_ROWS).dropDuplicates(["id", "d1", "d2"])
            .join(need, ["id", "d1", "d2"]).select("sid", "s"))
    sets = cut_lineage(sets, name)
    return (pairs.join(sets.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x")
            .join(sets.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y")
            .select("x", "y", F.size("sx").cast("long").alias("nx"), F.size("sy").cast("long").alias("ny"),
                    F.size(F.array_intersect("sx", "sy")).cast("long").alias("o")))


def _block(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent))).cast("int")


def _size(at: Column) -> Column:  # size and position of an entry are in one number
    return F.shiftright(at, 31)


def _place(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << 31) - 1))


def _most(at: Column, percent: int) -> Column:
    """Largest partner for which an entry can be the first common n-gram."""
    return F.floor((_size(at) - _place(at)) * F.lit(100 + percent) / F.lit(percent)).cast("long") - _size(at)


def listed(entries: DataFrame, by: str) -> DataFrame:
    """The entries (g, ...) of lists that hold two values of ``by`` or more."""
    own = Window.partitionBy("g")  # one shuffle; a list that is longer than the memory is spilled
    return entries.withColumns({"__a": F.min(by).over(own), "__z": F.max(by).over(own)}).where("__a != __z").drop("__a", "__z")


def leader_pairs(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (leader, set) from ``entries`` (g, sid, c, at): for each set the leader of another class it meets in most lists.

    A list's block names, in the first turn, the set that has the list's n-gram earliest, later and in ties the least by a hash of (set, turn).
    Copies with changes have rare n-grams of their own before it, the text in their middle has none and is linked with most of them. Leaders are
    taken by an aggregate that Spark combines before the shuffle, so a list of any length gives as many rows as it has entries.
    """
    e = entries.where(_most(F.col("at"), percent) >= _size(F.col("at")))
    rank = _place(F.col("at")) if turn == 0 else F.lit(0)
    e = e.select(F.xxhash64("g", _block(_size(F.col("at")), percent)).alias("k"), "sid", "c", "at", rank.alias("rank"))
    lead = e.groupBy("k").agg(F.min(F.struct("rank", F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "c", "at")).alias("l"), F.count("*").alias("m"))
    lead = lead.where("m > 1").select("k", F.col("l.sid").alias("x"), F.col("l.c").alias("cx"), F.col("l.at").alias("atx"))
    n, nx = _size(F.col("at")), _size(F.col("atx"))
    met = e.join(lead, "k").where((F.col("c") != F.col("cx")) & (n <= _most(F.col("atx"), percent)) & (nx <= _most(F.col("at"), percent)))
    met = met.groupBy("sid", "x").agg(F.count("*").alias("m"))
    return met.groupBy("sid").agg(F.max(F.struct("m", "x")).alias("b")).select(F.col("b.x").alias("x"), F.col("sid").alias("y"))


def index_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes from the blocked index over ``entries`` (g, sid, c, at): see step 2 of the module text."""
    # narrow rows, since they are shuffled: the list's and block's key, the set, its class, and its size with the position
    index = entries.select(F.xxhash64("g", _block(_size(F.col("at")), percent)).alias("k"), "sid", "c", "at")
    most = _most(F.col("at"), percent)
    probe = entries.where(most >= _size(F.col("at"))).select(
        "g", "sid", "c", "at", F.explode(F.sequence(_block(_size(F.col("at")), percent), _block(most, percent))).alias("b"))
    probe = probe.select(F.xxhash64("g", "b").alias("k"), F.col("sid").alias("x"), F.col("c").alias("cx"), F.col("at").alias("atx"))
    n, nx = _size(F.col("at")), _size(F.col("atx"))
    after = (n > nx) | ((n == nx) & (F.col("sid") > F.col("x")))
    hit = probe.join(index, "k").where(after & (F.col("c") != F.col("cx")) & (n <= _most(F.col("atx"), percent)) & (nx <= _most(F.col("at"), percent)))
    return hit.select("x", F.col("sid").alias("y")).distinct()


def _classes(rows: DataFrame, same: DataFrame, marks: DataFrame, entries: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(entries of lists with several classes, counted links of the leaders): see step 3 of the module text."""
    spark = rows.sparkSession
    ok = linked(F.col("o"), F.col("nx"), F.col("ny"), percent)
    live = cut_lineage(listed(entries, "sid").withColumn("c", F.col("sid")), "live")
    stars = None

    def merge(live: DataFrame, new: DataFrame) -> DataFrame:
        own = live.select("sid", "c").distinct()
        edges = (new.join(own.select(F.col("sid").alias("x"), F.col("c").alias("a")), "x")
                 .join(own.select(F.col("sid").alias("y"), F.col("c").alias("b")), "y").select("a", "b"))
        merged = components(edges, "merged").select(F.col("node").alias("c"), "component")
        live = live.join(merged, "c", "left").withColumn("c", F.coalesce("component", "c")).select("g", "sid", "at", "c")
        return listed(live, "c")

    for turn in itertools.count():
        open_sets = live.select("sid").distinct().count()
        new = _written(spark, "stars", lambda: _overlaps(rows, same, near(leader_pairs(live, percent, turn), marks, percent), words, "leaders").where(ok))
        stars = new if stars is None else stars.union(new)
        links = new.count()
        if links:
            live = _written(spark, "live", lambda: merge(live, new))
        if SETTLED * links <= open_sets:
            return live, stars


def _links(rows: DataFrame, same: DataFrame, marks: DataFrame, entries: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (x, y) between sets, enough of them for the groups: one class of leaders, and all pairs between classes."""
    live, stars = _classes(rows, same, marks, entries, words, percent)
    found = cut_lineage(near(index_pairs(live, percent), marks, percent), "found")

    # each set's best leader: of those it was linked with, the one that shares most
    best = stars.groupBy(F.col("y").alias("s")).agg(F.max(F.struct("o", "x", "nx", "ny")).alias("m")).select(
        "s", F.col("m.x").alias("lead"), (F.col("m.ny") - F.col("m.o")).alias("extra"), (F.col("m.nx") - F.col("m.o")).alias("short"))
    best = cut_lineage(best, "best")
    led = found
    for side in ("x", "y"):
        b = best.select(F.col("s").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("lead", "extra", "short")])
        led = led.join(b, side, "left").withColumn(f"lead_{side}", F.coalesce(f"lead_{side}", side))
        led = led.withColumns({f"{c}_{side}": F.coalesce(f"{c}_{side}", F.lit(0)) for c in ("extra", "short")})
    led = cut_lineage(led.withColumns({"p": F.least("lead_x", "lead_y"), "q": F.greatest("lead_x", "lead_y"),
                                       "extra": F.col("extra_x") + F.col("extra_y"), "short": F.col("short_x") + F.col("short_y")})
                      .select("x", "y", "p", "q", "extra", "short"), "led")
    asked = led.select(F.col("p").alias("x"), F.col("q").alias("y")).where("x != y").distinct()
    bases = _written(rows.sparkSession, "base_answers", lambda: _overlaps(rows, same, asked, words, "bases"))
    n = same.select("sid", "n")
    ask = (led.where("extra + short > 0")
           .join(bases.select(F.col("x").alias("p"), F.col("y").alias("q"), "nx", "ny", "o"), ["p", "q"])
           .where(~linked(F.col("o"), F.col("nx"), F.col("ny"), percent)).select("x", "y", "o", "extra", "short")
           .join(n.select(F.col("sid").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("sid").alias("y"), F.col("n").alias("ny")), "y"))
    least, most = F.col("o") - F.col("short"), F.least(F.col("o") + F.col("extra"), "nx", "ny")
    ask = cut_lineage(ask.withColumn("sure", linked(least, F.col("nx"), F.col("ny"), percent))
                      .where(linked(most, F.col("nx"), F.col("ny"), percent)), "ask")
    counted = _overlaps(rows, same, ask.where("NOT sure").select("x", "y"), words, "rest")
    ok = lambda d: d.where(linked(F.col("o"), F.col("nx"), F.col("ny"), percent)).select("x", "y")
    return stars.select("x", "y").union(ok(bases)).union(ask.where("sure").select("x", "y")).union(ok(counted))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = 85,
         bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(sizes, groups): key and n_shingles of every row; key and component_id of every key with a link.

    Null, empty and blank texts have the empty set, which links with nothing. Rows with one key are one node: each
    keeps its own size, and the links of all of them count for the key; a null key belongs to no group.
    ``component_id`` is the smallest key that links reach; keys without a link are not in ``groups`` (a key repeated with equal texts is
    there with itself). Both results are written; all other cuts are removed before the call returns.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kept = [shared_dir(spark, name) for name in ("sizes", "groups")]
    with scratch(spark):
        made = _summaries(rows, _sketch(rows, words, bits), words, percent, bits)
        made = cut_lineage(made.withColumn("sid", F.monotonically_increasing_id()), "sets")
        made.select("id", "n").write.parquet(kept[0])

        full = made.where("n > 0 AND id IS NOT NULL")
        same = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "sid")).alias("r"), F.count("*").alias("m"))
        same = cut_lineage(same.select("n", "d1", "d2", F.col("r.id").alias("rep"), F.col("r.sid").alias("sid"), "m"), "same")
        entries = full.select("sid", "n", "prefix").join(same.select("sid"), "sid").select("sid", "n", F.posexplode("prefix").alias("i", "g"))
        entries = entries.select("g", "sid", F.shiftleft("n", 31).bitwiseOR(F.col("i").cast("long")).alias("at"))
        links = _links(rows, same, made.select("sid", "n", "w"), entries, words, percent)
        rep = same.select("sid", "rep")
        links = (links.join(rep.select(F.col("sid").alias("x"), F.col("rep").alias("a")), "x")
                 .join(rep.select(F.col("sid").alias("y"), F.col("rep").alias("b")), "y").select("a", "b"))

        # a key is a node of its own beside its representative only if it stands for several sets
        owned = cut_lineage(full.select("id", "n", "d1", "d2").join(same, ["n", "d1", "d2"]).select("id", "rep", "m"), "owned")
        several = owned.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("id")
        links = links.union(owned.join(several, "id").select(F.col("rep").alias("a"), F.col("id").alias("b")))
        groups = components(links, "groups").select(F.col("node").alias("rep"), "component")
        groups = owned.join(groups, "rep", "left").where("m > 1 OR component IS NOT NULL")
        groups.select("id", F.coalesce("component", "rep").alias("component_id")).distinct().write.parquet(kept[1])
    sizes, groups = (spark.read.parquet(p).withColumnRenamed("id", key) for p in kept)
    return sizes.withColumnRenamed("n", "n_shingles"), groups


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the key itself without a link)."""
    sizes, groups = join(docs, key, text, **how)
    return sizes.join(groups, key, "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
