"""Exact substring dedup: bytes of a document that a 50-byte string covers which
also starts in a document with a smaller id.

Suffixes are sorted blockwise, one bucket at a time, with samples that cover
every long match.  The sample here is chosen by content: of each 50-byte window
the 24-byte string with the least hash (the leftmost of equals) is its anchor.
Equal windows have equal anchors at the same place, so every match is covered,
and with about a fourteenth of all positions; a difference cover by residues,
which needs six of 31, covers the same with three times as many.

1. ``sharing`` finds the anchors that occur in two documents at least.  All
   windows with another anchor are unique and need no more work.
2. Neighbouring windows with one anchor form a region of 76 bytes at most.
   Regions go to the bucket of their anchor.  Equal regions are one, under their
   least id; a task sends each once and the later ones are known as repeats.
3. A bucket's task sorts what precedes and what follows its anchors.  Neighbours'
   common lengths then rank, for each length, every left and right part; a
   window is its anchor between a left and a right rank, so ranks alone compare
   windows, however long their ties, and no window's bytes are sorted.
4. Spans go back to their documents.

Defined results: a null or empty text, and one shorter than 50 bytes, keeps all;
rows of one id are one another's equals, so none of them is smaller; a null id
is neither smaller nor larger than another and its row keeps all; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm import sharing
from moodspark.llm.common import byte_codes, map_arrow, mix64, rows_of, slices, utf8

LENGTH, ANCHOR = 50, 24
#: Anchors in a window, which is also the most windows in a region.
CHOICES = LENGTH - ANCHOR + 1
WIDTH = 80  # of a region, laid out around its anchor: 26 + 24 + 26, and room to the next word
#: Window starts of a long text that are worked on at once.
SEGMENT = 1 << 22
#: Kinds of packed rows beside those of ``sharing``: where a batch's regions are, and their bits.
WHERE, BITS = 3, 4
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_CODES = byte_codes(5)
_FACTORS = [np.uint64(pow(0xD1342543DE82EF95, 1 << i, 1 << 64)) for i in range(5)]
_PLACE = np.uint64((1 << 24) - 1)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 24 bytes from each position on."""
    h = _CODES[data]
    for i in range(3):
        h = h[:-(1 << i)] * _FACTORS[i] + h[1 << i:]
    both = h[:-8] * _FACTORS[3] + h[8:]
    return mix64(both[:-8] * _FACTORS[3] + h[16:])


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = anchor_hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    for i in range(4):
        least = np.minimum(least[:-(1 << i)], least[1 << i:])
    least = np.minimum(least[:n], least[CHOICES - 16:CHOICES - 16 + n])
    whole = np.zeros(n + 1, np.int32)     # windows that lie within one text
    size = np.diff(offsets)
    long = size >= LENGTH
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[:-1][long] + size[long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[:n]))
    at = (least[start] & _PLACE).astype(np.int64)
    new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return at[first], start[first], np.diff(np.append(first, len(at))), h[at[first]]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, first window, number of windows and key of each anchor, in order.

    A long text is worked on in segments: windows are local, so its anchors are
    those of the segments (one that two segments share appears in both).
    """
    if len(offsets) != 2 or len(data) <= SEGMENT + LENGTH:
        return _anchors(data, offsets)
    found = []
    for a in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[a:a + SEGMENT + LENGTH - 1]
        at, start, count, key = _anchors(part, np.array([0, len(part)]))
        found.append((at + a, start + a, count, key))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    at, _, _, key = anchors(data, offsets)
    return key, np.diff(np.searchsorted(at, offsets)), None


def regions(data: np.ndarray, offsets: np.ndarray, refs: list[bytes]) -> dict[str, np.ndarray]:
    """The regions of the anchors whose keys are among those that ``refs`` point to."""
    at, start, count, key = anchors(data, offsets)
    bound = np.searchsorted(at, offsets)
    use = np.zeros(len(at), bool)
    for d, r in enumerate(refs):
        own = key[bound[d]:bound[d + 1]]
        use[bound[d]:bound[d + 1]] = np.isin(own, own[np.frombuffer(r, "<u4")])
    at, start, count, key = at[use], start[use], count[use], key[use]
    doc = np.searchsorted(offsets, at, "right") - 1
    matrix = np.zeros((len(at), WIDTH), np.uint8)
    size = count + LENGTH - 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    left = at - start
    matrix.reshape(-1)[np.repeat(np.arange(len(at)) * WIDTH + CHOICES - 1 - left, size) + inside] = data[
        np.repeat(start, size) + inside]
    return {"key": key, "doc": doc, "start": start - offsets[doc], "left": left, "count": count, "matrix": matrix}


def signature(r: dict[str, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of a region: its bytes and how they lie around the anchor."""
    h = r["left"].astype(np.uint64) * np.uint64(64) + r["count"].astype(np.uint64)
    for word in r["matrix"].view("<u8").T:
        h = mix64(h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h


def known_repeats(r: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each region the place of the first of its equals by id, and whether its own id is larger."""
    order, new = sharing.first_of(r["key"], signature(r), ids)
    sig, key = signature(r)[order], r["key"][order]
    start = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) if len(order) else new
    group = np.cumsum(start) - 1
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(start)][group] if len(order) else 0
    # equal hashes of unequal regions: each stays by itself, which only costs work
    odd = (r["matrix"] != r["matrix"][first]).any(1) | (r["left"] != r["left"][first]) | (r["count"] != r["count"][first])
    first[odd] = np.flatnonzero(odd)
    return first, ids > ids[first]


def full(r: dict[str, np.ndarray]) -> np.ndarray:
    """A bit for each of a region's windows."""
    return (np.uint32(1) << r["count"].astype(np.uint32)) - np.uint32(1)


def common_lengths(group: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by group and bytes, and how many bytes each shares with
    the row before (-1 at a group's first)."""
    words = np.zeros((len(parts), 32), np.uint8)
    words[:, :parts.shape[1]] = parts
    order = np.lexsort((*words.view(">u8").T[::-1], group))
    differs = np.ones((len(parts), parts.shape[1] + 1), bool)
    differs[1:, :-1] = parts[order[1:]] != parts[order[:-1]]
    shared = differs.argmax(1)
    shared[np.append(True, group[order[1:]] != group[order[:-1]])] = -1
    return order, shared


def repeated_windows(r: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each region the bits of its windows that a smaller id has as well."""
    out = np.zeros(len(ids), np.uint32)
    if not len(ids):
        return out
    first, later = known_repeats(r, ids)
    heads = np.unique(first)
    key, matrix = r["key"][heads], r["matrix"][heads]
    anchor = matrix[:, CHOICES - 1:CHOICES - 1 + ANCHOR]
    # an anchor's rows: those of equal key and, to be exact, of equal bytes
    order, shared = common_lengths(key, np.ascontiguousarray(anchor))
    group = np.empty(len(heads), np.int64)
    group[order] = np.cumsum(shared < ANCHOR)
    busy = np.bincount(group)[group] > 1
    heads, group, matrix = heads[busy], group[busy], matrix[busy]
    if len(heads):
        side = CHOICES - 1
        before = common_lengths(group, np.ascontiguousarray(matrix[:, side - 1::-1]))
        after = common_lengths(group, np.ascontiguousarray(matrix[:, side + ANCHOR:side + ANCHOR + side]))
        lowest = side - r["left"][heads]                  # the column of a region's first window
        highest = lowest + r["count"][heads]
        own = ids[heads]
        bits = np.zeros(len(heads), np.uint32)
        rank = [np.empty(len(heads), np.int64) for _ in range(2)]
        for column in range(CHOICES):
            there = np.flatnonzero((lowest <= column) & (column < highest))
            for into, (order, shared), length in ((rank[0], before, side - column), (rank[1], after, column)):
                into[order] = np.cumsum(shared < length)
            pair = rank[0][there] * (len(heads) + 1) + rank[1][there]
            names, name = np.unique(pair, return_inverse=True)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, name, own[there])
            repeats = there[own[there] > least[name]]
            bits[repeats] |= np.uint32(1) << (column - lowest[repeats]).astype(np.uint32)
        out[heads] = bits
    out = out[first]
    out[later] = full(r)[later]
    return out


FIELDS = (("id", "<i8"), ("ref", "<u4"), ("left", "u1"), ("count", "u1"))


def _pack(r: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, ref: np.ndarray) -> bytes:
    """Regions for a bucket.  The anchor's hash is in its bytes; ids and places
    go as the steps from one to the next."""
    size = r["count"][at] + LENGTH - 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat = r["matrix"].reshape(-1)[np.repeat(at * WIDTH + CHOICES - 1 - r["left"][at], size) + inside]
    held = {"id": np.diff(ids[at], prepend=0), "ref": np.diff(ref, prepend=0), "left": r["left"][at], "count": r["count"][at]}
    head = b"".join(held[name].astype(kind).tobytes() for name, kind in FIELDS)
    return len(at).to_bytes(4, "little") + zlib.compress(head + flat.tobytes(), 1)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n, body, at, r = int.from_bytes(blob[:4], "little"), zlib.decompress(blob[4:]), 0, {}
    for name, kind in FIELDS:
        width = np.dtype(kind).itemsize
        r[name] = np.frombuffer(body, kind, n, at).astype(np.int64)
        at += n * width
    r["id"], r["ref"] = np.cumsum(r["id"]), np.cumsum(r["ref"])
    size = r["count"] + LENGTH - 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    matrix = np.zeros((n, WIDTH), np.uint8)
    matrix.reshape(-1)[np.repeat(np.arange(n) * WIDTH + CHOICES - 1 - r["left"], size) + inside] = np.frombuffer(body, np.uint8, -1, at)
    r["matrix"] = matrix
    anchor = np.ascontiguousarray(matrix[:, CHOICES - 1:CHOICES - 1 + ANCHOR])
    r["key"] = anchor_hashes(anchor.reshape(-1))[::ANCHOR].copy() if n else np.zeros(0, np.uint64)
    return r, r["ref"]


def _found(doc: np.ndarray, start: np.ndarray, bits: np.ndarray) -> bytes:
    return zlib.compress(np.stack([np.diff(doc, prepend=0), np.diff(start, prepend=0), bits]).astype("<i4").tobytes(), 1)


def _read_found(blob: bytes) -> np.ndarray:
    doc, start, bits = np.frombuffer(zlib.decompress(blob), "<i4").reshape(3, -1).astype(np.int64)
    return np.stack([np.cumsum(doc), np.cumsum(start), bits])


def scatter(batch: pa.RecordBatch, n: int) -> list[tuple]:
    data, offsets = utf8(batch.column(1))
    ids = batch.column(0).to_numpy()
    refs = batch.column(2).to_pylist()
    layout = ids.tobytes() + batch.column(3).to_numpy().tobytes()
    batch_no = sharing.batch_id(layout)
    rows = [(batch_no, batch_no % n, sharing.LAYOUT, layout)]
    parts = []
    for a, b in slices(offsets, sharing.SLICE):
        r = regions(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], refs[a:b])
        r["doc"] = r["doc"] + a
        parts.append(r)
    r = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    own = ids[r["doc"]]
    first, later = known_repeats(r, own)
    rows.append((batch_no, batch_no % n, sharing.FOUND, _found(r["doc"][later], r["start"][later], full(r)[later])))
    # one of each kind goes to its bucket; so do equals of the same id, whose bits are the first's
    send = np.flatnonzero(~later)
    for b, at in sharing.split(mix64(r["key"][send]) % np.uint64(n), n):
        rows.append((batch_no, b, sharing.DATA, _pack(r, own, send[at], at)))
    # a sent region's document and first window stay with the batch, by its place
    rows.append((batch_no, batch_no % n, WHERE, _found(r["doc"][send], r["start"][send], np.zeros(len(send), np.int64))))
    return rows


def resolve(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table.column(c).to_pylist() for c in sharing.NAMES), strict=True))
    out = [r for r in rows if r[2] != sharing.DATA]
    held = [r for r in rows if r[2] == sharing.DATA]
    if held:
        parts = [_unpack(r[3]) for r in held]
        r = {name: np.concatenate([p[0][name] for p in parts]) for name in parts[0][0]}
        bits = repeated_windows(r, r["id"])
        at = 0
        for row, (_, ref) in zip(held, parts, strict=True):
            own = bits[at:at + len(ref)]
            hit = own > 0
            at += len(ref)
            if hit.any():
                out.append((row[0], row[1], BITS, _found(ref[hit], np.zeros(int(hit.sum()), np.int64), own[hit])))
    return pa.Table.from_batches([sharing.packed(out)])


def gather(table: pa.Table) -> pa.Table:
    """A batch: the maximal removed spans of each of its documents."""
    rows = list(zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True))
    ids, numbers = np.frombuffer(next(b for k, b in rows if k == sharing.LAYOUT), "<i8").reshape(2, -1)
    where = _read_found(next(b for k, b in rows if k == WHERE))
    found = [_read_found(b) for k, b in rows if k == sharing.FOUND]
    for k, b in rows:
        if k == BITS:
            ref, _, bits = _read_found(b)
            found.append(np.stack([where[0][ref], where[1][ref], bits]))
    doc, start, bits = np.concatenate(found, axis=1)
    # runs of windows that go; a window is of one region, so runs of a document don't overlap
    window = np.zeros((len(bits), 34), np.int8)
    window[:, 1:33] = np.unpackbits(bits.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    edge = np.diff(window, axis=1)
    region, first_window = np.nonzero(edge == 1)
    after_last = np.nonzero(edge == -1)[1]
    doc, end, start = doc[region], start[region] + after_last - 1 + LENGTH, start[region] + first_window
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    out: dict[str, list] = {"doc_id": [], "row": [], "spans": []}
    if len(doc):
        head = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(doc)) - 1
        spans = np.stack([start[first], end[last]], 1)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(doc[first]) > 0)), len(first))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out["doc_id"].append(int(ids[doc[first[a]]]))
            out["row"].append(int(numbers[doc[first[a]]]))
            out["spans"].append(spans[a:b].astype("<i8").tobytes())
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "row": pa.array(out["row"], pa.int64()),
                     "spans": pa.array(out["spans"], pa.binary())})


def pack_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, packed``: the texts compressed, which two joins then share one shuffle of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([zlib.compress(t.encode(), 1) for t in batch.column(1).to_pylist()], pa.binary())],
                ["doc_id", "row", "packed"])

    return map_arrow(docs.select("doc_id", "text", "row"), run, "doc_id long, row long, packed binary")


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its second column, compressed texts, as texts again."""
    text = pa.array([zlib.decompress(z) for z in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
    return batch.set_column(1, "text", text)


def removed_spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``doc_id, row, spans`` (pairs of 64-bit byte positions) of documents that lose something."""
    n = sharing.buckets(docs)
    shared = sharing.shared_keys(docs, keys_of).select("doc_id", "row", "refs")
    held = packed.join(shared, ["doc_id", "row"]).select("doc_id", "packed", "refs", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sharing.parts_of(unpacked(batch)):
                yield sharing.packed(scatter(part, n))

    return (held.mapInArrow(run, sharing.PACKED)
            .groupBy("bucket").applyInArrow(resolve, sharing.PACKED)
            .groupBy("batch").applyInArrow(gather, "doc_id long, row long, spans binary")
            .dropDuplicates(["doc_id", "row"]))


def without_spans(text: bytes, spans: bytes | None) -> bytes:
    if not spans:
        return text
    out, at = [], 0
    for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of every document."""
    docs = rows_of(df, id_col, text_col)
    named = docs.where(F.col("doc_id").isNotNull())
    packed = pack_texts(named)
    marked = (packed.join(removed_spans(named, packed), ["doc_id", "row"], "left").select("doc_id", "packed", "spans")
              .unionByName(pack_texts(docs.where(F.col("doc_id").isNull()))
                           .select("doc_id", "packed", F.lit(None).cast("binary").alias("spans"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [zlib.decompress(z) for z in batch.column(1).to_pylist()]
            spans = batch.column(2).to_pylist()
            kept = [without_spans(t, s) for t, s in zip(text, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in text], pa.int64()),
                 pa.array([len(t) - len(k) for t, k in zip(text, kept, strict=True)], pa.int64()),
                 pa.array([len(s or b"") // 16 for s in spans], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_arrow(marked, run, SCHEMA + ", kept binary")
