"""Which keys of a document also occur in another one, in packed form.

Operators that look for shared content make many keys of each document, most of
which occur once.  A row for each would be mostly overhead, so a task packs the
keys of a batch of documents into one binary row for each bucket of the key
space.  A bucket's task finds the keys that come from two batches, and sends
each batch the places of its own (``ref``: the key's place in its batch).

Within its bucket a key is 32 bits of its hash; the places of a batch's keys go as
the steps between them, which are small.

A batch sends a key once, however many of its documents hold it (then it is
known to be shared already), so a key that a third of all documents hold costs
its bucket one entry for each batch.  Buckets hold equal shares of the keys by
hash; their number follows the session's shuffle partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moodspark.llm.common import mix64, ship, shuffle_partitions, slices, utf8

PACKED = "batch long, bucket int, kind int, blob binary"
NAMES = ["batch", "bucket", "kind", "blob"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
DATA, LAYOUT, FOUND = 0, 1, 2
#: Text of one batch, and of one step of vector work.
BATCH, SLICE = 8 << 20, 1 << 18
REF = np.uint64((1 << 32) - 1)
PER_PARTITION = 4

#: From the bytes and offsets of some texts: their keys, the number of each text's,
#: and a row of 64-bit numbers for each text that comes back with it (or None).
Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def buckets(df: DataFrame) -> int:
    return PER_PARTITION * shuffle_partitions(df.sparkSession)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], NAMES)


def batch_id(*parts: bytes) -> int:
    """A batch is known by its contents, so a task that runs again says the same."""
    a = zlib.crc32(parts[0])
    for p in parts:
        a = zlib.crc32(p, a)
    return (len(parts[0]) << 32 ^ zlib.adler32(b"".join(parts)) << 31 ^ a) & (1 << 62) - 1


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A record batch in pieces of at most ``BATCH`` bytes of its second column, the text."""
    _, offsets = utf8(batch.column(1))
    for a, b in slices(offsets, BATCH):
        yield batch.slice(a, b - a)


def split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that fall into it, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b]:ends[b + 1]]


def first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns (the first weighs most) and, in it, where a new combination starts."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            same &= c[order[1:]] == c[order[:-1]]
        new[1:] = ~same
    return order, new


def scatter_keys(batch: pa.RecordBatch, keys_of: Keys, n: int) -> list[tuple]:
    data, offsets = utf8(batch.column(1))
    ids = batch.column(0).to_numpy()
    keys, counts, more = [], [], []
    for a, b in slices(offsets, SLICE):
        k, c, m = keys_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        keys.append(k)
        counts.append(c)
        more.append(np.zeros((b - a, 0), np.uint64) if m is None else m)
    keys, counts, more = np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(more)
    layout = (len(ids).to_bytes(8, "little") + ids.tobytes() + batch.column(2).to_numpy().tobytes()
              + counts.astype("<u4").tobytes() + more.astype("<u8").tobytes())
    batch_no = batch_id(layout)
    doc = np.repeat(np.arange(len(ids)), counts)
    # once for each key and document, then once for each key
    order, new = first_of(keys, doc)
    order = order[new]
    k = keys[order]
    start = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    here = (np.bincount(group)[group] > 1) if len(k) else np.zeros(0, bool)
    rows = [(batch_no, batch_no % n, LAYOUT, layout),
            (batch_no, batch_no % n, FOUND, pack_steps(np.sort(order[here])))]
    once = np.sort(order[start])
    spread = mix64(keys[once])
    short = (spread >> np.uint64(32)).astype("<u4")
    rows += [(batch_no, b, DATA, pack_keys(short[at], once[at])) for b, at in split((spread & REF) % np.uint64(n), n)]
    return rows


def pack_steps(ascending: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ascending, prepend=0).astype("<u4").tobytes(), 1)


def unpack_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64))


def pack_keys(short: np.ndarray, refs: np.ndarray) -> bytes:
    return len(short).to_bytes(4, "little") + short.tobytes() + pack_steps(refs)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(blob, "<u4", n, 4), unpack_steps(blob[4 + 4 * n:])


def resolve_keys(table: pa.Table) -> pa.Table:
    """A bucket: pass on what isn't keys, and give each batch its keys that another has too."""
    rows = list(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True))
    out = [r for r in rows if r[2] != DATA]
    held = [r for r in rows if r[2] == DATA]
    if held:
        parts = [unpack_keys(r[3]) for r in held]
        value, ref = (np.concatenate(c) for c in zip(*parts, strict=True))
        of = np.repeat(np.arange(len(held)), [len(p[0]) for p in parts])
        order = np.argsort(value, kind="stable")
        key = value[order]
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        hit = np.sort(order[shared])
        refs = ref[hit]
        cuts = np.searchsorted(of[hit], np.arange(len(held) + 1))
        out += [(r[0], r[1], FOUND, pack_steps(refs[a:b])) for r, a, b in zip(held, cuts, cuts[1:], strict=False) if b > a]
    return pa.Table.from_batches([packed(out)])


def gather_keys(table: pa.Table) -> pa.Table:
    """A batch: for each document, the places of its keys that are shared."""
    kind, blob = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    layout = next(b for k, b in zip(kind, blob, strict=True) if k == LAYOUT)
    n = int.from_bytes(layout[:8], "little")
    ids, numbers = np.frombuffer(layout, "<i8", 2 * n, 8).reshape(2, -1)
    counts = np.frombuffer(layout, "<u4", n, 8 + 16 * n).astype(np.int64)
    more = np.frombuffer(layout, "<i8", -1, 8 + 20 * n).reshape(n, -1) if n else np.zeros((0, 0), np.int64)
    refs = np.unique(np.concatenate([unpack_steps(b) for k, b in zip(kind, blob, strict=True) if k == FOUND]))
    before = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.searchsorted(refs, before)
    has = np.arange(n) if more.shape[1] else np.flatnonzero(np.diff(cuts))
    return pa.table({
        "doc_id": pa.array(ids[has], pa.int64()),
        "row": pa.array(numbers[has], pa.int64()),
        "n_shared": pa.array(np.diff(cuts)[has], pa.int64()),
        "refs": pa.array([(refs[cuts[i]:cuts[i + 1]] - before[i]).astype("<u4").tobytes() for i in has], pa.binary()),
        "more": pa.array([m.tolist() for m in more[has]], pa.list_(pa.int64()))})


def shared_keys(docs: DataFrame, keys_of: Keys) -> DataFrame:
    """``doc_id, row, n_shared, refs, more`` of the documents (``doc_id, text, row``) with
    shared keys; of all documents, if ``keys_of`` has numbers to send back with them.

    ``refs`` are the places (little-endian 32 bits) of shared keys in the
    document's own list, one for each different key.  A key may be called shared
    that isn't, by a collision of hashes, but none that is shared is left out.
    """
    ship(docs.sparkSession)
    n = buckets(docs)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                yield packed(scatter_keys(part, keys_of, n))

    return (docs.mapInArrow(scatter, PACKED)
            .groupBy("bucket").applyInArrow(resolve_keys, PACKED)
            .groupBy("batch").applyInArrow(gather_keys, "doc_id long, row long, n_shared long, refs binary, more array<long>")
            .dropDuplicates(["doc_id", "row"]))
