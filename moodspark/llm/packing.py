"""Best-fit packing of token sequences, after a dominance reduction.

A document's identifiers are cut into pieces of at most ``capacity`` tokens:
all of a long document's pieces are full but the first, which holds the rest.
Pieces are then packed into as few sequences as it can.

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the corpus is counted by length (one aggregation), the plan is made on those
counts, and every piece finds its place by its rank among pieces of its length:

* reduction (after Martello and Toth): for a piece j, a set F holding j is fixed
  for good when it dominates every other set that holds j, that is when each
  such set's other members fit, one or several together, into members of F.
  Counts let many copies of the same set be fixed at once.
* best fit, longest first, places what is left.

The plan's size depends on ``capacity`` alone: best fit opens or splits at most
a few groups of equal sequences for each length, and a sequence holds at most
``sqrt(2 * capacity)`` different lengths.  Ranks are counted in salted buckets,
so one length may hold any share of all rows.

Defined results: a null or empty text has the end token alone; repeated rows
are packed each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import map_arrow, texts
from moodspark.session import reliable_checkpoint

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one salt, of all lengths; a rank window holds those of one length.
RANK_ROWS = 200_000


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str):
    """A function from texts to lists of identifiers.

    Byte-level vocabularies with the usual pattern go through tiktoken with
    the ranks taken from the same file; it gives the same identifiers several
    times faster.  Others, and texts on which it fails, take the library
    itself.
    """
    import json

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer_path)

    def plainly(text: str) -> list[int]:
        return library().encode(text, add_special_tokens=False).ids

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    level = spec.get("pre_tokenizer") or {}
    if (spec.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space")
            or spec["model"].get("type") != "BPE" or not level.get("use_regex", True)):
        return plainly
    import tiktoken
    from public_tokenizers import PATTERN

    # the byte-level alphabet: printable bytes stand for themselves, the others
    # follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in own}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    vocabulary = spec["model"]["vocab"]
    ranks = {bytes(letter[c] for c in w): i for w, i in vocabulary.items() if w not in special}
    # its merges must be in the order of the identifiers, as tiktoken takes them
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
    order = [vocabulary[m] for m in merged]
    if order != sorted(order):
        return plainly
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # its regex engine gives up on some texts by a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return plainly(text)

    return encode


def pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document; the identifiers stay in the task, their checksum leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.asarray([*(encode(text) if text else ()), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return map_arrow(texts(df, id_col, text_col), run, PIECES)


class _Counts:
    """How many pieces of each length are left, with neighbour searches."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def take(self, lengths, times: int) -> None:
        for w in lengths:
            self.n[w] -= times
            if not self.n[w]:
                del self.n[w]
                self.keys.remove(w)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The longest length up to ``most`` that is left beside ``without``; 0 if none."""
        for i in range(bisect.bisect_right(self.keys, most) - 1, -1, -1):
            if self.n[self.keys[i]] > without.count(self.keys[i]):
                return self.keys[i]
        return 0

    def smallest(self, how_many: int, above: int = 0, without: tuple[int, ...] = ()) -> list[int]:
        """The shortest lengths over ``above``, with repeats, that are left beside ``without``."""
        out: list[int] = []
        for k in self.keys[bisect.bisect_right(self.keys, above):]:
            out += [k] * min(how_many - len(out), self.n[k] - without.count(k))
            if len(out) == how_many:
                break
        return out


def dominating(left: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates every set with ``j``, or None.

    With r the room beside ``j`` and a the longest piece that fits there:

    * nothing fits: {j};
    * a fills r, or no two pieces fit in r: {j, a}; any set's other members
      fit together into a;
    * at most two fit, and b is the longest that fits beside a: {j, a, b} if
      no two pieces longer than b fit in r.  A single other member fits into
      a; of two, one fits into b and the other into a.
    """
    r = capacity - j
    a = left.largest(r, (j,))
    if not a:
        return (j,)
    two = left.smallest(2, 0, (j,))
    if a == r or len(two) < 2 or sum(two) > r:
        return (j, a)
    three = left.smallest(3, 0, (j,))
    if len(three) == 3 and sum(three) <= r:
        return None
    b = left.largest(r - a, (j, a))
    if not b:
        return None
    longer = left.smallest(2, b, (j,))
    if len(longer) == 2 and sum(longer) <= r:
        return None
    return (j, a, b)


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix dominating sets until none is found; give them, and what is left."""
    left, fixed = _Counts(counts), []
    found = True
    while found:
        found = False
        for j in sorted(left.n, reverse=True):
            while j in left.n and (chosen := dominating(left, j, capacity)):
                uses = {w: chosen.count(w) for w in chosen}
                # pieces that go can't spoil dominance, so the set stands while its
                # members last
                times = min(left.n[w] // k for w, k in uses.items())
                for w, k in uses.items():
                    left.take([w], times * k)
                fixed.append((chosen, times))
                found = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: groups of equal sequences, by their room."""
    rooms: dict[int, list[list]] = defaultdict(list)  # room: [contents, times]
    order: list[int] = []

    def put(room: int, contents: tuple[int, ...], times: int) -> None:
        if room not in rooms or not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append([contents, times])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect.bisect_left(order, w)
            if i == len(order):
                per = capacity // w
                if n >= per:
                    put(capacity - per * w, (w,) * per, n // per)
                if n % per:
                    put(capacity - n % per * w, (w,) * (n % per), 1)
                n = 0
                continue
            room = order[i]
            contents, times = rooms[room].pop()
            if not rooms[room]:
                order.pop(i)
            per = room // w
            whole = min(times, n // per)
            rest = n - whole * per if whole < times else 0
            rest = min(rest, per - 1) if whole < times else 0
            if whole:
                put(room - per * w, contents + (w,) * per, whole)
            if rest:
                put(room - rest * w, contents + (w,) * rest, 1)
            if times - whole - bool(rest):
                put(room, contents, times - whole - bool(rest))
            n -= whole * per + rest
    return [(contents, times) for groups in rooms.values() for contents, times in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, from_rank, to_rank, per, first_sequence, first_offset)`` of every
    run of pieces of one length in a group of equal sequences."""
    fixed, left = reduce(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for contents, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for w in sorted(set(contents), reverse=True):
            per = contents.count(w)
            out.append((w, ranks[w], ranks[w] + per * times, per, sequence, offset))
            ranks[w] += per * times
            offset += per * w
        sequence += times
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with the sequence that holds it and its place there."""
    spark = df.sparkSession
    # the cut is read twice (counts, then places), so it is kept where all can read it
    cut = reliable_checkpoint(pieces(df, tokenizer_path, end_id, capacity, id_col, text_col))
    total = cut.count()
    buckets = max(1, -(-total // RANK_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    salted = cut.withColumn("salt", salt)
    # at most capacity x buckets rows: one for RANK_ROWS / capacity pieces or more
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counted.select("length", "salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (salted.withColumn("rank", rank.cast("long")).join(before, ["length", "salt"])
              .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))))
    runs = spark.createDataFrame(
        plan(counts, capacity),
        "length long, from_rank long, to_rank long, per long, first_sequence long, first_offset long")
    # the plan's size depends on the capacity alone; a length is one row with its runs,
    # so a piece meets one row, and its run is picked from there
    by_length = runs.groupBy("length").agg(F.collect_list(F.struct(
        "from_rank", "to_rank", "per", "first_sequence", "first_offset")).alias("runs"))
    own = F.element_at(F.filter("runs", lambda r: (F.col("rank") >= r["from_rank"]) & (F.col("rank") < r["to_rank"])), 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("run", own)
    i = F.col("rank") - F.col("run.from_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first_sequence") + F.floor(i / F.col("run.per"))).cast("long").alias("sequence_id"),
        (F.col("run.first_offset") + F.pmod(i, F.col("run.per")) * F.col("length")).cast("long").alias("offset"))
