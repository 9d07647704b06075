"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a string: at each step it writes the character under
it and moves on, or stays, by a random bit that depends on the step and the
character alone.  Strings at a small edit distance walk together again after
each edit, so their embeddings are at a small Hamming distance.

A text is cut into chunks where its content says so (a hash of the last
8 characters; 32 characters at most), which keeps an edit's effect local, and
all chunks walk at once; a walk that comes to its chunk's end goes on at its start.  A sampled step gives one random bit of the step and the
character under it.  Each of 4 bands has 15 sampled steps and 16 bins; a chunk falls
into one bin of each band by its last 8 characters, and of a bin's chunks the one
whose characters hash least gives its 15 bits (an edit inside a chunk changes some of
its bits, not the choice).  So the fingerprint is a sample of bits of the embedding,
and the Hamming distance of two fingerprints measures that of the embeddings.

Likeness is 1 - 2 * distance / bits (bits that are by chance alike are half), over the
bins that either fills; a bin that only one fills counts as by chance.  Alike documents
are found by bands of bits: groups of ``WIDTH`` bins are keys, documents that share a key are
candidates, and the whole fingerprints verify them (``linked`` for pairs at hand,
``near_links`` over a table).

Defined results: a null or empty text has an empty fingerprint, alike (1.0) to
another empty one and not (0.0) to any other; rows of one id follow one another
by text; a null id comes first; the row after the last is the first, also when
it is the only one; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import map_arrow, mix64, powers, shuffle_partitions, texts

BINS, BANDS, MARK, CHUNK, LONGEST = 64, 4, 8, 16, 32
#: Sampled steps of a band; bins of a key; the least likeness of a link.
BITS, WIDTH, LEAST = 15, 2, 0.5
SAMPLED = [[3 * i + band for i in range(BITS)] for band in range(BANDS)]
#: Characters that are worked on at once.
SLICE = 1 << 19
NOTHING = np.int64(-(1 << 63))
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, bands_edited int, linked_edited boolean, linked_next boolean")

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = mix64(np.arange(1, 16 * LONGEST, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=offsets[1:])
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64), offsets


def chunks(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each chunk, and the text that it is of."""
    n = len(points)
    h, width = points * _STEP + np.uint64(1), 1
    while width < MARK:  # the hash of the 8 characters from each place on
        h = h[:len(h) - width] * np.uint64(0xD1342543DE82EF95 ** width % (1 << 64)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    marks = np.flatnonzero((mix64(h) & np.uint64(CHUNK - 1)) == 0) + MARK   # a chunk ends before this place
    text = np.searchsorted(offsets, marks - 1, "right") - 1
    marks = marks[marks - MARK >= offsets[text]]
    cuts = np.unique(np.concatenate([marks, offsets]))
    start, length = cuts[:-1], np.diff(cuts)
    pieces = -(-length // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, whole = np.repeat(start, pieces) + nth * LONGEST, np.repeat(length, pieces)
    length = np.minimum(whole - nth * LONGEST, LONGEST)
    return start, length, np.searchsorted(offsets, start, "right") - 1


def walk(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``chunks x BANDS``: the bits that the bands sample of each chunk's walk."""
    out = np.zeros((BANDS, len(start)), np.uint64)
    at, end = start.copy(), start + length
    wanted: dict[int, list[tuple[int, np.uint64]]] = {}
    for band, steps in enumerate(SAMPLED):
        for i, step in enumerate(steps):
            wanted.setdefault(step, []).append((band, np.uint64(i)))
    for step in range(max(wanted) + 1):
        h = points[at]
        h += _STEPS[step]
        h *= _STEP
        h ^= h >> np.uint64(29)
        for band, i in wanted.get(step, ()):
            out[band] |= (h >> np.uint64(40) & np.uint64(1)) << i
        h >>= np.uint64(17)
        h &= np.uint64(1)
        at += h.view(np.int64)
        at = np.where(at == end, start, at)
    return out.T


def fingerprints(strings: list[str]) -> np.ndarray:
    """``len(strings) x BINS`` of 16 bits: 0, or the highest bit and the 15 of the bin's chunk."""
    points, offsets = code_points(strings)
    bins = np.full(len(strings) * BINS, np.iinfo(np.uint64).max, np.uint64)
    if len(points):
        start, length, text = chunks(points, offsets)
        sums = np.zeros(len(points) + 1, np.uint64)
        power = powers(_STEP, len(points))
        np.cumsum((points + np.uint64(9)) * _STEPS[0] * power[:-1], out=sums[1:], dtype=np.uint64)
        back = powers(np.uint64(pow(int(_STEP), -1, 1 << 64)), len(points))

        def named(a: np.ndarray, n: np.ndarray) -> np.ndarray:
            return mix64((sums[a + n] - sums[a]) * back[a] + n.astype(np.uint64))

        # equal chunks walk alike, so one of them walks for all
        _, first, same = np.unique(named(start, length), return_index=True, return_inverse=True)
        bits = walk(points, start[first], length[first])[same] | np.uint64(1 << BITS)
        mark = np.minimum(length, MARK)
        mark = named(start + length - mark, mark)
        per = BINS // BANDS
        for band in range(BANDS):
            order = mix64(mark + np.uint64((band + 1) * int(_STEP) % (1 << 64)))
            slot = text * BINS + band * per + (order & np.uint64(per - 1)).astype(np.int64)
            # least by the mark's hash, then by the bits
            np.minimum.at(bins, slot, (order & ~np.uint64(0xFFFF)) | bits[:, band])
    return np.where(bins == np.iinfo(np.uint64).max, 0, bins & np.uint64(0xFFFF)).astype(">u2").reshape(-1, BINS)


def hexes(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - 2 * Hamming distance / bits, at least 0; 1.0 where neither fills a bin."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    either, both = (a > 0) | (b > 0), (a > 0) & (b > 0)
    distance = np.where(both, np.bitwise_count(a ^ b), 0).sum(1) + (either & ~both).sum(1) * (BITS / 2)
    filled = either.sum(1)
    return np.where(filled > 0, np.maximum(0.0, 1 - 2 * distance / np.maximum(filled * BITS, 1)), 1.0)


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys (groups of ``WIDTH`` bins, not all empty) two fingerprints share."""
    same = (a == b).reshape(len(a), -1, WIDTH).all(2)
    return (same & (a.reshape(len(a), -1, WIDTH) > 0).any(2)).sum(1)


def linked(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Whether bands make a pair a candidate and the whole fingerprints verify it."""
    empty = ~(a > 0).any(1) & ~(b > 0).any(1)
    return (empty | (shared_bands(a, b) > 0)) & (likeness(a, b) >= least)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """``block, extra, doc_id, text`` sorted by these: each block's documents in
    order and then, as extra, the document after its last.

    Blocks are ranges of ids of about equal numbers of rows.  Their bounds and
    first ids, a few numbers for each block, are all that the driver sees.
    """
    bounds = np.asarray(sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile(
        "doc_id", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else [])

    def order_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        key = ids.cast(pa.int64()).fill_null(int(NOTHING)).to_numpy(zero_copy_only=False)
        return key, np.searchsorted(bounds, key.astype(np.float64), "right")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, block = order_of(batch.column(0))
            found = [(int(b), int(key[block == b].min())) for b in np.unique(block)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["block", "key"])

    first = sorted(map(tuple, map_arrow(docs.select("doc_id"), firsts, "block long, key long")
                       .groupBy("block").agg(F.min("key").alias("key")).collect()))
    before = {key: first[i - 1][0] for i, (_, key) in enumerate(first)}
    keys = np.asarray([key for _, key in first], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, block = order_of(batch.column(0))
            twice = np.flatnonzero(np.isin(key, keys))
            take = pa.array(np.concatenate([np.arange(len(key)), twice]))
            extra = np.arange(len(take)) >= len(key)
            block = np.concatenate([block, [before[int(key[i])] for i in twice]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(extra), batch.column(0).take(take), batch.column(1).take(take)],
                ["block", "extra", "doc_id", "text"])

    return (map_arrow(docs, deal, "block long, extra boolean, doc_id long, text string")
            .repartition(blocks, "block").sortWithinPartitions("block", "extra", "doc_id", "text"))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = texts(df, id_col, text_col)

    def rows(group: list[tuple]) -> pa.RecordBatch:
        changes = [edited(text, following) for _, text, following in group]
        # a text is also what follows another, and copies are equal
        place: dict[str, int] = {}
        of = [[place.setdefault(s, len(place)) for s in strings]
              for strings in ([g[1] for g in group], changes, [g[2] for g in group])]
        prints = fingerprints([*place])
        own, changed, after = (prints[i] for i in of)
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in group], pa.int64()), pa.array([len(g[1]) for g in group], pa.int64()),
             pa.array([hashlib.sha256(s.encode()).hexdigest() for s in changes], pa.string()),
             pa.array(hexes(own), pa.string()), pa.array(hexes(changed), pa.string()),
             pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, after), pa.float64()),
             pa.array(shared_bands(own, changed), pa.int32()), pa.array(linked(own, changed)), pa.array(linked(own, after))],
            [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = None, [], 0   # held: the block, id and text that wait for the next
        closed = None
        for batch in batches:
            for block, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == block:
                    group.append((held[1], held[2], text))
                    size += 2 * len(held[2]) + len(text)
                    if size > SLICE:
                        yield rows(group)
                        group, size = [], 0
                held = None if extra or closed == block else (block, doc, text)
                closed = block if extra else closed
        if group:
            yield rows(group)

    return map_arrow(with_next(docs, shuffle_partitions(df.sparkSession)), run, SCHEMA)


def alike(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings."""
    def bins(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.conv(F.substring(c, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))

    pairs = F.filter(F.arrays_zip(bins(a).alias("a"), bins(b).alias("b")), lambda x: (x["a"] > 0) | (x["b"] > 0))
    far = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when((x["a"] > 0) & (x["b"] > 0), F.bit_count(
        x["a"].bitwiseXOR(x["b"])).cast("double")).otherwise(BITS / 2))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - 2 * far / (F.size(pairs) * BITS)))


def near_links(prints: DataFrame, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """``doc_id, other, likeness``: documents linked to the first document of each
    group that shares a key of ``width`` bins with them, where the whole
    fingerprints are alike enough.  A key's first document is found by partial
    sums, so a key that many share costs each of them one join row.  Pairs that share
    a key but whose link to its first document fails are left out: tests measure how
    many of all alike pairs are in one class of links."""
    keys = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BINS // width - 1)), lambda i: F.struct(
        i.alias("i"), F.substring("fingerprint", i * (4 * width) + 1, F.lit(4 * width)).alias("bins"))),
        lambda k: k["bins"] != "0" * (4 * width))
    keyed = prints.select("doc_id", "fingerprint", F.explode(keys).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "fingerprint")).alias("first"))
    pairs = (keyed.join(first, "key").where(F.col("doc_id") > F.col("first.doc_id"))
             .select("doc_id", "fingerprint", F.col("first.doc_id").alias("other"), F.col("first.fingerprint").alias("theirs"))
             .dropDuplicates(["doc_id", "other"]))
    return (pairs.withColumn("likeness", alike(F.col("fingerprint"), F.col("theirs")))
            .where(F.col("likeness") >= least).select("doc_id", "other", "likeness"))
