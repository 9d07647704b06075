"""Benchmark decontamination by SimHash over item-sized windows.

Texts become words (runs of letters, digits and apostrophes, ASCII lower case)
and shingles of five words (fewer where an item has fewer).  Each benchmark item
slides over each document in a window of its own number of words.

1. For each size that items have, windows are taken where enough shingles in a row of
   that size are any item's (a window as similar as asked has so many); which items
   they are isn't asked.
2. A window's 64-bit SimHash finds the items of its size by multi-index Hamming
   search: fingerprints are cut into 8 blocks of 8 bits, and of two within the
   radius of 23 at least one block differs in 2 bits at most.  Each block's
   table has a bucket of items for each value; the buckets of the values within 2
   bits of the window's list every item within the radius, and the whole distance is
   then compared.  An item that no bucket lists isn't found.
3. The candidates are verified by weighted shingle similarity: the sum of the
   smaller over the sum of the larger counts of each shingle.

At a similarity of 0.8 the distance is 10 bits on average with a deviation
under 3, so the radius leaves out a matching window with odds near 1 : 10**6.

Items are a stated query set: they go to the tasks in blocks of bounded size,
one pass over the documents for each block.  A block's index takes about four times
its items' bytes (shingles and counts, 8 table entries an item); it is broadcast, and
the driver's Python holds one at a time.

Defined results: a null or empty text or item matches nothing; of a document's
windows the first of the most similar ones is given for each item; repeated rows
of documents and items give their pairs each; a document shorter than the item
is one window; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import byte_codes, kept_rows, map_arrow, mix64, powers, ship, slices, spans, texts, utf8

WORDS, LEAST = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Bytes of items in one block.
ITEM_BYTES = 8 << 20
#: Windows that are looked up at once.
WINDOWS = 4096
SLICE = 1 << 18
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (97, 123)):
    _WORD[_a:_b] = True
_WORD[ord("'")] = True
_CODES = byte_codes(11)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NEXT = powers(np.uint64(0xD1342543DE82EF95), WORDS)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many words come before each row (and in all)."""
    low = _LOWER[data]
    start, end = spans(_WORD[low], offsets)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_CODES[low] * powers(_STEP, len(low))[:len(low)], out=sums[1:], dtype=np.uint64)
    hashes = mix64((sums[end] - sums[start]) * powers(_BACK, len(low))[start])
    return hashes, np.searchsorted(start, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix64(sum((words[j:j + n] * _NEXT[j] for j in range(width)), np.zeros(n, np.uint64)) + np.uint64(width))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """For each prefix of the shingles, how many set each of the 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:], dtype=np.int32)
    return out


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` shingles."""
    counts = sums[size:] - sums[:-size]
    return np.packbits(counts * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


#: What a block's value may be changed by within its share of the radius.
_CHANGES = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS).astype(np.uint8)


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return start[of] + np.arange(n.sum()) - (np.cumsum(n) - n)[of], of


class SameSize:
    """The items of one number of words: their fingerprints in a multi-index."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, width: int, size: int):
        self.items, self.prints, self.width, self.size = items, prints, width, size
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        #: for each block: items by its value, and where each value's bucket starts
        self.order = np.argsort(blocks, axis=0, kind="stable").astype(np.int32)
        self.bucket = np.stack([np.searchsorted(np.sort(blocks[:, b]), np.arange(257)) for b in range(BLOCKS)])

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (by place), items (by place here) and distances within the radius,
        of those that the buckets list."""
        value = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        listed = []
        for b in range(BLOCKS):
            asked = (value[:, b, None] ^ _CHANGES[None, :]).ravel()
            at, of = ranges(self.bucket[b][asked], self.bucket[b][asked.astype(np.int64) + 1])
            listed.append((of // len(_CHANGES)) * len(self.prints) + self.order[at, b])
        pair = np.unique(np.concatenate(listed))
        window, item = pair // len(self.prints), pair % len(self.prints)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
        use = distance <= RADIUS
        return window[use], item[use], distance[use]


class Items:
    """An index of a block of benchmark items."""

    def __init__(self, ids: list[int], words: list[np.ndarray], least: float):
        self.least = least
        self.ids = np.asarray(ids, np.int64)
        self.known, self.count = [], []
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        by_width: dict[int, list[np.ndarray]] = {}
        for i, w in enumerate(words):
            width = min(len(w), WORDS)
            s = shingles(w, width)
            known, count = np.unique(s, return_counts=True)
            self.known.append(known)
            self.count.append(count.astype(np.int32))
            groups.setdefault((width, len(s)), []).append((i, simhashes(bit_sums(s), len(s))[0]))
            by_width.setdefault(width, []).append(known)
        self.sizes = [SameSize(np.array([i for i, _ in held]), np.array([p for _, p in held], np.uint64), width, size)
                      for (width, size), held in sorted(groups.items())]
        #: by width: every item's shingles, and whether a shingle's last 20 bits are any's
        self.shingles = {width: np.unique(np.concatenate(held)) for width, held in by_width.items()}
        self.probes = {width: np.zeros(1 << 20, bool) for width in by_width}
        for width, keys in self.shingles.items():
            self.probes[width][keys & np.uint64((1 << 20) - 1)] = True

    def similarity(self, found: np.ndarray, item: int, size: int) -> np.ndarray:
        """Weighted similarity of the item with every window of ``size`` of the shingles ``found``."""
        known, count = self.known[item], self.count[item]
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        held = np.zeros((len(found) + 1, len(known)), np.int32)
        held[1:][np.flatnonzero(hit), at[hit]] = 1
        np.cumsum(held, axis=0, out=held)
        both = np.minimum(held[size:] - held[:-size], count[None, :]).sum(1)
        return both / (size + count.sum() - both)

    def search(self, words: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """``item, similarity, first word, words, distance`` of the best window of each item that matches."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for width, keys in self.shingles.items():
            s = shingles(words, width)
            if not len(s):
                continue
            any_item = keys[np.minimum(np.searchsorted(keys, s), len(keys) - 1)] == s
            if not any_item.any():
                continue
            before = np.concatenate([[0], np.cumsum(any_item)])
            for group in self.sizes:
                if group.width == width:
                    self._windows(group, s, before, best)
        return [(i, *best[i]) for i in sorted(best)]

    def _windows(self, group: SameSize, s: np.ndarray, before: np.ndarray, best: dict) -> None:
        size = min(group.size, len(s))
        # what is as similar as asked shares so many shingles at least
        least = np.ceil(self.least * (size + group.size) / (1 + self.least) - 1e-9)
        starts = np.flatnonzero(before[size:] - before[:-size] >= least)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for at in range(0, len(run), WINDOWS):
                part = run[at:at + WINDOWS]
                if not len(part):
                    continue
                lo = int(part[0])
                held = s[lo:int(part[-1]) + size]
                window, item, distance = group.near(simhashes(bit_sums(held), size)[part - lo])
                for i in np.unique(item):
                    own = window[item == i]
                    first, last = int(part[own[0]]), int(part[own[-1]])
                    alike = self.similarity(s[first:last + size], int(group.items[i]), size)[part[own] - first]
                    k = int(alike.argmax())
                    name = int(group.items[i])
                    if alike[k] >= self.least - 1e-12 and alike[k] > best.get(name, (-1.0,))[0]:
                        best[name] = (float(alike[k]), int(part[own[k]]), size + group.width - 1, int(distance[item == i][k]))


def indexes(items: DataFrame, least: float = LEAST, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """Broadcast indexes of the items that have words, in blocks of bounded size."""
    ship(items.sparkSession)
    named = texts(items, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    total = named.select(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // ITEM_BYTES))
    out = []
    for block in range(n):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").toArrow()
        words, before = word_hashes(*utf8(rows.column("text")))
        held = [(i, words[a:b]) for i, a, b in zip(rows.column("item_id").to_pylist(), before, before[1:], strict=False) if b > a]
        if held:
            # the block's bytes are bounded, and so is its index
            out.append(items.sparkSession.sparkContext.broadcast(Items([i for i, _ in held], [w for _, w in held], least)))
    return out


def search_texts(index: Items, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
    """The texts (by place) that match an item, and ``Items.search`` of each."""
    mask = np.uint64((1 << 20) - 1)
    for a, b in slices(offsets, SLICE):
        words, before = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        # most texts hold no item's shingle: one look at all of a slice's tells which may
        maybe: set[int] = set()
        for width, probe in index.probes.items():
            seen = np.flatnonzero(probe[shingles(words, width) & mask])
            maybe |= set((np.searchsorted(before, seen, "right") - 1).tolist())
        for d in sorted(maybe):
            if found := index.search(words[before[d]:before[d + 1]]):
                yield a + d, found


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text",
            item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each pair of a document and an item that it holds; no shuffle."""
    out = None
    for index in indexes(items, least, item_id_col, item_text_col):
        block = _block_matches(texts(docs, id_col, text_col), index)
        out = block if out is None else out.unionByName(block)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _block_matches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(ids[d], int(index.ids[i]), *rest)
                     for d, hits in search_texts(index, *utf8(batch.column(1))) for i, *rest in hits]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)],
                ["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"])

    return map_arrow(docs, run, SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows, whole and as they are, that match no item; no shuffle."""
    place = docs.columns.index(text_col)
    for index in indexes(items, least):
        docs = _block_clean(docs, index, place)
    return docs


def _block_clean(docs: DataFrame, shared: Broadcast, place: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            clean = np.ones(len(batch), bool)
            clean[[d for d, _ in search_texts(index, *utf8(batch.column(place)))]] = False
            yield from kept_rows(batch, place, clean)

    return map_arrow(docs, run, docs.schema)
