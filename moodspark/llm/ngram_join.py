"""Exact n-gram Jaccard join by signature trees, given as classes.

A document is its set of distinct word 4-shingles (64-bit hashes); two link when
``100 * intersection >= 85 * union``.  The classes are the components of links.

1. Equal sets are one.  Of its shingles in hash order, two that link share so
   many of the first quarter that most documents are out at once: their
   shingles are their own (``sharing``).  What the bound rests on: sets that
   link with i common shingles share l of the first ``n - i + l`` of each.
2. The rest meet under shingles.  Under each, a signature tree is laid over the
   sets by size: a node has the OR of its sets' token bitmaps, the range of
   their sizes, and their class if it is one.  Two trees' nodes (or one's) are
   walked down together; a pair is dropped when its sizes are too far apart,
   its class is the same, or the bitmaps' common bits leave too small an
   overlap.  Sets that are left are compared by their shingles.
3. First each set meets others under its two least shingles, and what is found
   to link becomes one class (``components``).  Then all meet under every
   shingle of their prefix (of which linked sets share one), but only those of
   different classes are still compared.  So a large group of near copies
   doesn't cost all its pairs, and no link between classes is lost.

A shingle that many sets hold is split: in the first step into chunks that each
hold the group's least and greatest set; in the second into all pairs of parts,
which together hold all pairs of sets.

Defined results: a text without words has an empty set, 0 shingles and is its
own class; one with fewer than 4 words has one shingle, the whole; rows of one
id are one document, linked by all their texts; a row without an id has no class
(null); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm import sharing
from moodspark.llm.common import byte_codes, map_arrow, mix64, powers, rows_of, ship, slices, spans, utf8
from moodspark.llm.components import components
from moodspark.session import reliable_checkpoint, scratch_path

#: Sets of one chunk in the first step, and of one part in the second.
CHUNK, PART = 512, 2048
#: Ids of sets to read the texts of are broadcast up to this many bytes.
BROADCAST_BYTES = 16 << 20
FANOUT = 16
#: Shingles of its prefix that a set carries along to tell where a pair met first.
FIRST = 6
#: Node pairs, and words of their bitmaps, that are compared at once.
PAIRS, WORDS = 1 << 14, 1 << 18
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = byte_codes(23)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Measure:
    """The threshold, as ``percent`` of the union, and what follows from it."""

    def __init__(self, percent: int = 85, width: int = 4):
        self.percent, self.width = percent, width

    def kept(self, n):
        """The least overlap of a set of n with any that it links with."""
        return -(-n * self.percent // 100)

    def prefix(self, n):
        return n - self.kept(n) + 1

    def wide(self, n, part: int = 10):
        """A prefix longer by ``n // part``, of which linked sets share more."""
        return np.minimum(n, n - self.kept(n) + 1 + n // part)

    def needed(self, n, part: int = 10):
        """How many of its wide prefix a set must share to link with any: a set that
        it links with has ``kept(n)`` shingles at least."""
        return 1 + self.kept(n) // part

    def links(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The ordered distinct shingle hashes of each text."""
    low = _LOWER[data]
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    start, end = spans(~gap, offsets)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_CODES[low] * powers(_STEP, len(low))[:len(low)], out=sums[1:], dtype=np.uint64)
    word = mix64((sums[end] - sums[start]) * powers(_BACK, len(low))[start])
    before = np.searchsorted(start, offsets)
    factor = powers(np.uint64(0xD1342543DE82EF95), width)
    n = max(0, len(word) - width + 1)
    run = np.zeros(n, np.uint64)
    for j in range(width):
        run += word[j:j + n] * factor[j]
    run = mix64(run + np.uint64(width))
    out = []
    for a, b in zip(before.tolist(), before[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(run[a:b - width + 1]))
        elif b > a:
            few = np.uint64(sum(int(w) * int(f) for w, f in zip(word[a:b], factor, strict=False)) % (1 << 64))
            out.append(mix64(np.array([few + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two, twice its size or more."""
    return max(256, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[mix64(tokens) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def fold(rows: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits: a token's bit is its hash modulo the size."""
    half = rows.shape[1] // 2
    return rows[:, :half] | rows[:, half:]


class Tree:
    """A signature tree over sets, in the order of their sizes."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        bits, n, label = bits[self.order], n[self.order], label[self.order]
        slack = n - np.bitwise_count(bits).sum(1).astype(np.int64)   # tokens that share a bit
        self.levels = [(bits, n, n, slack, label)]
        while len(bits) > FANOUT:
            cuts = np.arange(0, len(bits), FANOUT)
            bits, (_, lo, hi, slack, label) = np.bitwise_or.reduceat(bits, cuts), self.levels[-1]
            lo, hi, slack = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(slack, cuts)
            one = np.minimum.reduceat(label, cuts)
            label = np.where(one == np.maximum.reduceat(label, cuts), one, -1 - np.arange(len(cuts)))
            self.levels.append((bits, lo, hi, slack, label))

    def _may(self, level: int, i: np.ndarray, j: np.ndarray, m: Measure) -> np.ndarray:
        bits, lo, hi, slack, label = self.levels[level]
        near = (hi[i] * 100 >= m.percent * lo[j]) & (hi[j] * 100 >= m.percent * lo[i]) & (
            (label[i] != label[j]) | ((i == j) & (label[i] < 0)))
        i, j = i[near], j[near]
        common = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
        if level:
            most = common + np.minimum(slack[i], slack[j])
        else:  # every bit of one set that the other lacks is a token that it lacks
            most = np.minimum(lo[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), lo[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1))
        near[near] = (100 + m.percent) * most >= m.percent * (lo[i] + lo[j])
        return near

    def pairs(self, m: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (by their places in the input) that may link, some at a time."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]), 0 if top else 1)
        yield from self._down(top, i, j, m)

    def _down(self, level: int, i: np.ndarray, j: np.ndarray, m: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, min(PAIRS, WORDS // self.levels[level][0].shape[1]))
        for at in range(0, len(i), step):
            a, b = i[at:at + step], j[at:at + step]
            may = self._may(level, a, b, m)
            a, b = a[may], b[may]
            if not len(a):
                continue
            if not level:
                yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][0])
            inner = np.arange(FANOUT)
            x = np.repeat(a[:, None] * FANOUT + inner, FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * FANOUT + inner, (1, FANOUT)).ravel()
            use = (x < below) & (y < below) & ((x <= y) if level > 1 else (x < y))
            yield from self._down(level - 1, x[use], y[use], m)


def may_link(n: np.ndarray, bitmaps: list[bytes], label: np.ndarray, m: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may link; bitmaps of two sizes are compared in the smaller."""
    size = np.array([len(b) for b in bitmaps])
    for s in np.unique(size):
        own, wide = np.flatnonzero(size == s), np.flatnonzero(size == 2 * s)
        both = np.concatenate([own, wide])
        rows = [np.frombuffer(b"".join(bitmaps[i] for i in own), "<u8").reshape(len(own), -1)]
        if len(wide):
            rows.append(fold(np.frombuffer(b"".join(bitmaps[i] for i in wide), "<u8").reshape(len(wide), -1)))
        for i, j in Tree(np.concatenate(rows), n[both], label[both]).pairs(m):
            use = (i < len(own)) | (j < len(own))
            yield both[i[use]], both[j[use]]


class Classes:
    """Union-find over the sets of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.of(a)] = self.of(b)


def groups(table: pa.Table, columns: list[str]) -> Iterator[np.ndarray]:
    """Places of the rows that agree in ``columns``, where there are two at least."""
    keys = [table.column(c).to_numpy() for c in columns]
    if len(table):
        order, new = sharing.first_of(*keys)
        cuts = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                yield order[a:b]


def link_group(node: list[int], sets: list[np.ndarray], m: Measure) -> list[tuple[int, int]]:
    """Links that join the sets of one group into classes; each is verified."""
    n = np.array([len(s) for s in sets])
    classes, found = Classes(len(node)), []
    maps = [bitmap(s, bitmap_bits(len(s))).tobytes() for s in sets]
    for i, j in may_link(n, maps, np.arange(len(node)), m):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if classes.of(a) != classes.of(b):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if m.links(both, len(sets[a]), len(sets[b])):
                    classes.join(a, b)
                    found.append((node[a], node[b]))
    return found


LINKS = "a long, b long"


def _pairs_table(pairs) -> pa.Table:
    pairs = list(pairs)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def first_links(sets: DataFrame, m: Measure, n_buckets: int) -> DataFrame:
    """Verified links among sets under their two least shingles."""
    held = sets.select("node", F.explode(F.slice("prefix", 1, 2)).alias("token"))
    sizes = (held.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("least"), F.max("node").alias("greatest"))
             .where(F.col("c") > 1))
    chunks = F.ceil(F.col("c") / CHUNK).cast("int")
    # the least and the greatest set of a group are in all its chunks
    everywhere = (F.col("node") == F.col("least")) | (F.col("node") == F.col("greatest"))
    chunk = F.when(everywhere, F.sequence(F.lit(0), chunks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))
    # the sets themselves join those that meet any
    dealt = (held.join(sizes, "token").select("token", "node", F.explode(chunk).alias("chunk"))
             .join(sets.select("node", "tokens"), "node")
             .withColumn("bucket", F.pmod(F.xxhash64("token", "chunk"), F.lit(n_buckets)).cast("int")))

    def link(table: pa.Table) -> pa.Table:
        node, tokens = table.column("node").to_pylist(), table.column("tokens").to_pylist()
        return _pairs_table(p for at in groups(table, ["token", "chunk"]) for p in link_group(
            [node[i] for i in at], [np.frombuffer(tokens[i], "<u8") for i in at], m))

    return dealt.groupBy("bucket").applyInArrow(link, LINKS)


def other_pairs(sets: DataFrame, classes: DataFrame, m: Measure, n_buckets: int) -> DataFrame:
    """Pairs of sets of different classes that may link, under any shingle of their prefixes.

    A set that links with one of another class shares shingles of its (longer)
    prefix with other classes in number; the sets that don't are out.  Under the
    first shingle that both have, no more can be common than either set has left
    from there on.  A pair that has an earlier shingle in common, as far as the
    sets' first ``FIRST`` tell, is made there and not here again.
    """
    named = (sets.select("node", "prefix", "short", "needed").join(classes, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    postings = named.select("node", "component", "short", "needed", F.posexplode("prefix").alias("place", "token"))
    mixed = (postings.groupBy("token").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
             .where(F.col("x") != F.col("y")).select("token", F.ceil(F.col("c") / PART).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # part i meets part j in the cell of both, so all pairs of sets meet
    cell = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j))
    met = postings.join(mixed, "token").withColumn("met", F.count("*").over(Window.partitionBy("node")))
    dealt = (met.where((F.col("met") >= F.col("needed")) & (F.col("place") < F.col("short")))
             .select("token", "place", "node", "component", F.explode(cell).alias("cell"))
             .join(sets.select("node", "n", "bitmap", "prefix"), "node")
             .withColumn("earlier", F.slice("prefix", F.lit(1), F.least("place", F.lit(FIRST)))).drop("prefix")
             .withColumn("bucket", F.pmod(F.xxhash64("token", "cell"), F.lit(n_buckets)).cast("int")))

    def meet(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_numpy(), table.column("component").to_numpy()
        n, maps = table.column("n").to_numpy(), table.column("bitmap").to_pylist()
        left = n - table.column("place").to_numpy()
        earlier = table.column("earlier")
        found: set[tuple[int, int]] = set()
        for at in groups(table, ["token", "cell"]):
            _, classes = np.unique(label[at], return_inverse=True)
            before: dict[int, set[int]] = {}
            for i, j in may_link(n[at], [maps[k] for k in at], classes, m):
                x, y = at[i], at[j]
                enough = (100 + m.percent) * np.minimum(left[x], left[y]) >= m.percent * (n[x] + n[y])
                for a, b in zip(x[enough].tolist(), y[enough].tolist(), strict=True):
                    for k in (a, b):
                        if k not in before:
                            before[k] = set(earlier[k].as_py())
                    if before[a].isdisjoint(before[b]):
                        found.add((min(node[a], node[b]), max(node[a], node[b])))
        return _pairs_table(sorted(found))

    return dealt.groupBy("bucket").applyInArrow(meet, LINKS).distinct()


def verified(pairs: DataFrame, sets: DataFrame, m: Measure) -> DataFrame:
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            hit = []
            for k in range(len(a)):
                p, q = np.frombuffer(x[k], "<u8"), np.frombuffer(y[k], "<u8")
                if m.links(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                    hit.append((a[k], b[k]))
            yield from _pairs_table(hit).to_batches()

    return map_arrow(joined, run, LINKS)


def join_ngrams(df: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see the module's text."""
    m = Measure(percent, width)
    docs = rows_of(df, id_col, text_col)
    spark = df.sparkSession
    ship(spark)
    n_buckets = sharing.buckets(df)

    def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = shingle_sets(data, offsets, width)
        part = [s[:int(m.wide(len(s)))] for s in sets]
        name = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<u8") for s in sets]
        more = np.column_stack([np.array([len(s) for s in sets], np.uint64), np.stack(name)])
        return np.concatenate(part), np.array([len(p) for p in part]), more

    named = docs.where(F.col("doc_id").isNotNull())
    # short rows of all documents; read several times
    known = reliable_checkpoint(sharing.shared_keys(named, keys_of).select(
        "doc_id", "row", "n_shared", F.col("more")[0].alias("n"), F.col("more")[1].alias("s1"), F.col("more")[2].alias("s2")))
    kept = F.ceil(F.col("n") * percent / F.lit(100))
    able = known.where((F.col("n") > 0) & (F.col("n_shared") >= 1 + F.floor(kept / 10)))
    same = able.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    heads = reliable_checkpoint(same.select("s1", "s2", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")))
    small = heads.count() * 16 <= BROADCAST_BYTES
    chosen = heads.select("doc_id", "row")
    texts_of = named.join(F.broadcast(chosen) if small else chosen, ["doc_id", "row"], "left_semi").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                     pa.array([bitmap(s, bitmap_bits(len(s))).tobytes() for s in sets], pa.binary()),
                     pa.array([s[:int(m.wide(len(s), 20))].view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                     pa.array([m.prefix(len(s)) for s in sets], pa.int64()),
                     pa.array([m.needed(len(s), 20) for s in sets], pa.int64())],
                    ["node", "n", "tokens", "bitmap", "prefix", "short", "needed"])

    path = scratch_path(spark, "shingle-sets")
    map_arrow(texts_of, run, "node long, n long, tokens binary, bitmap binary, prefix array<long>, short long, needed long").write.parquet(path)
    sets = spark.read.parquet(path)

    found = reliable_checkpoint(first_links(sets, m, n_buckets))
    # texts of one id are linked by it
    ids = able.join(same, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b")).where("a != b")
    classes = components(found)
    more = verified(other_pairs(sets, classes, m, n_buckets), sets, m)
    one = components(found.unionByName(more).unionByName(ids))
    result = known.join(one.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return named.select("doc_id", "row").join(result, ["doc_id", "row"]).select(
        "doc_id", "n_shingles", "component_id").unionByName(_nameless(docs, width))


def keep_one(docs: DataFrame, percent: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the least id of each class, one for each id; rows without an id stay."""
    classes = join_ngrams(docs, percent, width, id_col, text_col)
    gone = reliable_checkpoint(classes.where(F.col("doc_id") != F.col("component_id"))
                               .select(F.col("doc_id").alias(id_col)).distinct())
    small = gone.count() * 16 <= BROADCAST_BYTES
    left = docs.join(F.broadcast(gone) if small else gone, id_col, "left_anti").select(*docs.columns)
    twice = reliable_checkpoint(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count()
                                .where(F.col("count") > 1).select(id_col))
    if twice.limit(1).count():
        again = left.join(twice, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
        left = left.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(again)
    return left


def _nameless(docs: DataFrame, width: int) -> DataFrame:
    """Rows without an id: their sets' sizes and no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*utf8(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64())], ["n_shingles"])

    rows = docs.where(F.col("doc_id").isNull()).select("doc_id", "text")
    none = F.lit(None).cast("long")
    return map_arrow(rows, run, "n_shingles long").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"))
