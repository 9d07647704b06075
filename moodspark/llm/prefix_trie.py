"""Trie of conversation prefixes, summed up by time-forward processing.

Each distinct sequence of first turns is a node, known by a polynomial hash of its
turns (modulo 2**127 - 1, over hashes of role and text), so that no text leaves the
scan.  The job:

1. Turns are sorted by conversation through a range shuffle.  A partition may begin
   or end inside a conversation; what the next one must know of it (turns so far, their
   hash, the last few) is put together in the driver, a row a partition.  So a
   conversation that holds a third of all turns is dealt over many tasks.
2. Each conversation's path becomes pieces of at most ``BAND`` nodes.
3. Nodes with many members are *heavy*: at most 9 * ``MOST_HEAVY``, since members of
   all nodes are the turns; they are broadcast as keys.  A light node belongs to the
   *shard* of the first light node above it within its band of ``BAND`` levels, so a
   shard has a bounded number of members whatever is popular.
4. Within a shard nodes are sorted by reverse level order (Spark's external sort), and
   each passes its subtree's totals to its parent through a priority queue that spills
   sorted runs to the executor's own spill folder.  A node takes its children's messages when its turn
   comes, and hands them its own id.
5. Shard roots pass their totals on: to a light parent in the band above, as messages
   of the next round (one round for each ``BAND`` levels), or to heavy nodes, as sums by
   parent.  Heavy nodes, which are bounded, are processed in the same way at the end.

Defined results: a null role or text is empty; a null turn comes first; equal turn
numbers are ordered by the hash of role and text; repeated rows are turns each; rows
without a conversation id are left out; an empty table has no node; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import map_arrow
from moodspark.session import scratch_path

#: Conversations of a family may share the first turns of its first member ...
FAMILY, MOST_SHARED = 5, 8
#: Levels of a band, so nodes of a piece at most.
BAND = 4096
#: A node with more members than this, and than turns / MOST_HEAVY, is heavy.
MIN_HEAVY, MOST_HEAVY = 64, 50_000
#: Messages that a queue holds in memory, and turns of a row of sorted turns.
QUEUE_ROWS, CHUNK_ROWS = 200_000, 4096
#: Ids that go into one row on their way to a heavy node's hash.
ENDS_ROWS = 4096

PRIME, BASE = 2 ** 127 - 1, 0x5DEECE66D1B873593CC9E2D51B54A32F
ROOT = 1


def _key(state: int) -> bytes:
    return state.to_bytes(16, "big")


def _fold(state: int, xs: Iterable[bytes]) -> int:
    for x in xs:
        state = (state * BASE + int.from_bytes(x, "big")) % PRIME
    return state


def shared_turns(conv_id: int, family: int) -> int:
    """How many first turns a conversation takes from its family's first member."""
    return 0 if conv_id == family else zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


# ---------------------------------------------------------------------------
# 1. sorted turns
# ---------------------------------------------------------------------------

TURNS = "part int, seq long, conv binary, family binary, x binary, nbytes binary, state binary"


@dataclass
class Tail:
    """What a partition knows of its last conversation and family."""

    first: int = 0
    conv: int = 0
    family: int = 0
    count: int = 0
    fold: int = 0
    recent: list[bytes] = field(default_factory=list)
    head: list[bytes] = field(default_factory=list)
    base: list[tuple[bytes, int]] = field(default_factory=list)


def sorted_turns(conversations: DataFrame, family: int = FAMILY, levels: int = BAND) -> DataFrame:
    """Turns in order, many to a row, and a last row for each partition with its ``Tail``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    c = F.col("conv_id").cast("long")
    turns = conversations.where(c.isNotNull()).select(
        (c - c % family).alias("family"), c.alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(said, 1, 32)).alias("x"), F.octet_length(text).cast("long").alias("nbytes"))
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "x"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    keep = levels + MOST_SHARED

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, tail = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                b = batch.slice(at, CHUNK_ROWS)
                family, conv = (b.column(i).to_numpy() for i in (0, 1))
                xs, nbytes = b.column(3).to_pylist(), b.column(4).to_numpy()
                if tail is None:
                    tail = Tail(int(conv[0]), int(conv[0]), int(family[0]))
                last, of = int(conv[-1]), int(family[-1])
                if of != tail.family:
                    tail.family, tail.base = of, []
                if len(tail.base) < MOST_SHARED:
                    rows = np.flatnonzero((family == of) & (conv == of))[:MOST_SHARED - len(tail.base)]
                    tail.base += [(xs[i], int(nbytes[i])) for i in rows]
                if last != tail.conv:
                    tail.conv, tail.count, tail.fold, tail.recent, tail.head = last, 0, 0, [], []
                own = [xs[i] for i in np.flatnonzero(conv == last)]
                tail.count, tail.fold = tail.count + len(own), _fold(tail.fold, own)
                tail.head = (tail.head + own[:MOST_SHARED])[:MOST_SHARED]
                tail.recent = (tail.recent + own)[-keep:]
                yield _batch(TURNS, [(part, seq, conv.tobytes(), family.tobytes(), b"".join(xs), nbytes.tobytes(), None)])
                seq += 1
        if tail is not None:
            yield _batch(TURNS, [(part, -1, None, None, None, None, pickle.dumps(tail))])

    return map_arrow(ordered.select("family", "conv_id", "turn", "x", "nbytes"), pack, TURNS)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def entering(tails: list[tuple[int, Tail]], levels: int = BAND) -> tuple[dict[int, Tail], set[int]]:
    """What each partition must know when it begins inside a family (its ``Tail`` from
    all before), and the partitions whose last conversation goes on in the next."""
    known, goes_on, now, before = {}, set(), None, None
    for part, t in tails:
        if now is not None:
            known[part] = now
            if t.first == now.conv:
                goes_on.add(before)
        base = (now.base + t.base)[:MOST_SHARED] if now is not None and now.family == t.family else t.base
        if now is not None and t.first == t.conv == now.conv:
            now = Tail(t.first, t.conv, t.family, now.count + t.count, (now.fold * pow(BASE, t.count, PRIME) + t.fold) % PRIME,
                       (now.recent + t.recent)[-(levels + MOST_SHARED):], (now.head + t.head)[:MOST_SHARED], base)
        else:
            now = Tail(t.first, t.conv, t.family, t.count, t.fold, t.recent, t.head, base)
        before = part
    return known, goes_on


# ---------------------------------------------------------------------------
# 2. paths in pieces
# ---------------------------------------------------------------------------

PIECES = "conv_id long, depth long, first boolean, before binary, lead binary, keys binary, nbytes binary, ended boolean"


class Path:
    """A conversation's nodes as its turns come in, handed out a band at a time.

    ``depth`` counts all nodes, ``lead`` are the keys of the band's nodes that were
    handed out earlier, ``keys`` those that weren't, ``above`` the key over the band.
    """

    def __init__(self, conv: int, family: int, base: list[tuple[bytes, int]], levels: int = BAND):
        self.levels, self.conv, self.shared = levels, conv, shared_turns(conv, family)
        self.base = base[:self.shared]
        self.count, self.depth, self.state, self.first = 0, 0, ROOT, True
        self.above, self.lead, self.keys, self.nbytes, self.done = _key(ROOT), [], [], [], []
        for x, n in self.base:
            self._node(x, n)

    @classmethod
    def resume(cls, tail: Tail, base: list[tuple[bytes, int]], levels: int = BAND) -> "Path":
        """The path of a conversation that began in an earlier partition."""
        p = cls(tail.conv, tail.family, base, levels)
        p.count, p.first = tail.count, False
        own = max(0, tail.count - p.shared)
        if own:
            # the turns that count: all, less the first ones, under the base's
            power = pow(BASE, own, PRIME)
            p.state = (p.state * power + tail.fold - _fold(0, tail.head[:p.shared]) * power) % PRIME
        p.depth = len(p.base) + own
        p.lead, p.keys, p.nbytes, p.done = [], [], [], []
        held = (p.depth - 1) % levels + 1 if p.depth else 0
        xs = [x for x, _ in p.base] + tail.recent[max(0, len(tail.recent) - own):]
        xs = xs[len(xs) - held:]
        start = ROOT if held == p.depth else (p.state - _fold(0, xs)) * pow(BASE, -held, PRIME) % PRIME
        p.above, state = _key(start), start
        for x in xs:
            state = _fold(state, [x])
            p.lead.append(_key(state))
        return p

    def _node(self, x: bytes, nbytes: int) -> None:
        if self.depth and self.depth % self.levels == 0:
            above = (self.keys or self.lead)[-1]
            if self.keys:
                self._hand_out(False)
            self.above, self.lead = above, []
        self.state = _fold(self.state, [x])
        self.depth += 1
        self.keys.append(_key(self.state))
        self.nbytes.append(nbytes)

    def _hand_out(self, ended: bool) -> None:
        self.done.append((self.conv, self.depth - len(self.keys) + 1, self.first, self.above, b"".join(self.lead),
                          b"".join(self.keys), np.array(self.nbytes, np.int64).tobytes(), ended))
        self.lead, self.keys, self.nbytes, self.first = self.lead + self.keys, [], [], False

    def turn(self, x: bytes, nbytes: int) -> None:
        if self.count >= self.shared:
            self._node(x, nbytes)
        self.count += 1

    def close(self, ended: bool) -> None:
        if ended or self.keys or self.first:
            self._hand_out(ended)


def paths(turns: DataFrame, levels: int = BAND) -> DataFrame:
    """Pieces of all paths, from sorted turns (written before)."""
    spark = turns.sparkSession
    tails = [(r.part, pickle.loads(r.state)) for r in
             turns.where("seq = -1").select("part", "state").orderBy("part").collect()]  # a row a partition
    known = spark.sparkContext.broadcast(entering(tails, levels))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter, goes_on = known.value
        part = path = family = None
        base: list[tuple[bytes, int]] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if path is not None:
                        path.close(part not in goes_on)
                        out += path.done
                    part, path, family, base = row["part"], None, None, []
                    tail = enter.get(part)
                    if tail is not None:
                        family, base = tail.family, list(tail.base)
                conv, families = (np.frombuffer(row[c], np.int64).tolist() for c in ("conv", "family"))
                nbytes, x = np.frombuffer(row["nbytes"], np.int64).tolist(), row["x"]
                for i, (c, f, n) in enumerate(zip(conv, families, nbytes)):
                    if path is None or c != path.conv:
                        if path is not None:
                            path.close(True)
                            out += path.done
                        if f != family:
                            family, base = f, []
                        if path is None and tail is not None and tail.conv == c:
                            path = Path.resume(tail, base, levels)
                        else:
                            path = Path(c, f, base, levels)
                    said = x[16 * i:16 * i + 16]
                    if c == f and len(base) < MOST_SHARED:
                        base.append((said, n))
                    path.turn(said, n)
                    if path.done:
                        out += path.done
                        path.done = []
                    if len(out) >= 2000 or path.depth >= levels and out:
                        yield _batch(PIECES, out)
                        out = []
        if path is not None:
            path.close(part not in goes_on)
            out += path.done
        if out:
            yield _batch(PIECES, out)

    rows = turns.where("seq >= 0").drop("state").repartition("part").sortWithinPartitions("part", "seq")
    return map_arrow(rows, walk, PIECES)


# ---------------------------------------------------------------------------
# 3. rows of shards
# ---------------------------------------------------------------------------

NODES = ("unit binary, depth long, key binary, kind int, conv_id long, parent binary, nbytes long, n long, ended boolean, "
         "children long, leaves long, saved long, ends string, under_light boolean")


def _split(keys: bytes) -> list[bytes]:
    return [keys[i:i + 16] for i in range(0, len(keys), 16)]


def node_keys(pieces: DataFrame) -> DataFrame:
    """``key``: one row for each member of each node but the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            places = np.arange(len(data) // 16 + 1, dtype=np.int32) * 16
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(
                pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])], ["key"])

    return map_arrow(pieces.select("keys"), run, "key binary")


def members(pieces: DataFrame, heavy, light: bool, band: int | None = None, levels: int = BAND) -> DataFrame:
    """A row for each member of each node: of light nodes (of one band) with their
    shard in ``unit``, or of heavy nodes and the root.  Where a path ends at a node that
    an earlier piece holds, a row of no member says so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popular, out = heavy.value, []
        for batch in batches:
            for r in batch.to_pylist():
                conv, lead, own = r["conv_id"], _split(r["lead"]), _split(r["keys"])
                held = lead + own
                above = r["depth"] - len(lead)
                nbytes = np.frombuffer(r["nbytes"], np.int64).tolist()
                top = next((i for i, k in enumerate(held) if k not in popular), len(held))
                unit = held[top] if light and top < len(held) else None
                rootless = r["ended"] and not held
                if not light and (r["first"] or rootless):
                    out.append((None, 0, _key(ROOT), 0, conv, None, 0, int(r["first"]), rootless, 0, 0, 0, None, False))
                for i in range(len(lead) if own else max(len(held) - 1, 0), len(held)):
                    ended = r["ended"] and i == len(held) - 1
                    if (i >= top) == light and (own or ended):
                        parent = held[i - 1] if i else r["before"]
                        out.append((unit, above + i, held[i], 0, conv, parent, nbytes[i - len(lead)] if own else 0,
                                    int(bool(own)), ended, 0, 0, 0, None, i == 0 and parent not in popular))
                if len(out) >= 10_000:
                    yield _batch(NODES, out)
                    out = []
        if out:
            yield _batch(NODES, out)

    # a piece without nodes marks the one before its depth
    last = F.col("depth") - 1 - (F.octet_length("keys") == 0).cast("int")
    return map_arrow(pieces if band is None else pieces.where(F.floor(last / levels) == band), run, NODES)


# ---------------------------------------------------------------------------
# 4. time-forward processing
# ---------------------------------------------------------------------------

class SpillingQueue:
    """A priority queue of tuples; beyond ``most`` its content goes to a sorted run on
    disk, of which only the head stays in memory."""

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.held, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.held, item)
        if len(self.held) > self.most:
            # the executor's own spill folder; a lost task makes its runs anew
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            run = tempfile.TemporaryFile(dir=folder)
            self.held.sort()
            for at in range(0, len(self.held), 1000):
                pickle.dump(self.held[at:at + 1000], run)
            self.held = []
            run.seek(0)
            self._head(self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _head(self, run: Iterator[tuple]) -> None:
        item = next(run, None)
        if item is not None:
            heapq.heappush(self.runs, (item, id(run), run))

    def __len__(self) -> int:
        return len(self.held) + len(self.runs)

    def pop_of(self, start: tuple) -> Iterator[tuple]:
        """Takes the items that begin with ``start``; it must be no greater than any held."""
        while True:
            spilled = bool(self.runs) and (not self.held or self.runs[0][0] < self.held[0])
            source = self.runs[0][0] if spilled else self.held[0] if self.held else None
            if source is None or source[:len(start)] != start:
                return
            if spilled:
                item, _, run = heapq.heappop(self.runs)
                self._head(run)
                yield item
            else:
                yield heapq.heappop(self.held)


TOTALS = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends_sha256 string, top boolean, parent binary, under_light boolean")


def time_forward(rows: Iterator[pa.RecordBatch], queue_rows: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Totals of nodes from rows sorted by shard, falling depth, key, kind and id.

    A message holds the child's finished row but for its parent's id.  A shard's root
    has no parent here: its row goes out marked ``top``.
    """
    queue, out, now = SpillingQueue(queue_rows), [], None

    def finish() -> None:
        nonlocal n, children, leaves, saved
        for m in queue.pop_of((-depth, key)):
            below.append(m[3:])
        for c, cn, cchildren, cleaves, csaved, cends in below:
            out.append((c, depth + 1, conv, cn, cchildren, cleaves, csaved, cends, False, None, False))
            children, leaves, saved = children + 1, leaves + cleaves, saved + csaved
        row = (conv, n, children, leaves if children else 1, saved + (n - 1) * nbytes, ends or digest.hexdigest())
        if key == unit or (parent is None):
            out.append((conv, depth, None, *row[1:], True, parent, under_light))
        else:
            queue.push((1 - depth, parent, key, *row))

    for batch in rows:
        columns = [c.to_pylist() for c in batch.columns]
        for u, d, k, kind, c, p, size, count, ended, ch, le, sa, en, ul in zip(*columns):
            if now != (u, d, k):
                if now is not None:
                    finish()
                    if len(out) >= 10_000:
                        yield _batch(TOTALS, out)
                        out = []
                now = unit, depth, key = u, d, k
                conv, parent, nbytes, n, children, leaves, saved, ends = None, p, 0, 0, 0, 0, 0, None
                digest, some, below, under_light = hashlib.sha256(), False, [], False
            if kind == 1:
                below.append((c, count, ch, le, sa, en))
                continue
            conv = c if conv is None else min(conv, c)
            parent, nbytes, under_light = p, max(nbytes, size), under_light or ul
            n, children, leaves, saved, ends = n + count, children + ch, leaves + le, saved + sa, ends or en
            if ended and en is None:
                digest.update((b"," if some else b"") + str(c).encode())
                some = True
    if now is not None:
        finish()
    if out:
        yield _batch(TOTALS, out)


def _process(rows: DataFrame, queue_rows: int) -> DataFrame:
    """One round over shards, written."""
    ordered = rows.sortWithinPartitions("unit", F.desc("depth"), "key", "kind", "conv_id")
    return _written(map_arrow(ordered, lambda batches: time_forward(batches, queue_rows), TOTALS), "trie-totals")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _messages(tops: DataFrame, unit, key) -> DataFrame:
    """Shard roots' rows as messages to the shard that holds their parent."""
    return tops.select(unit.alias("unit"), (F.col("depth") - 1).alias("depth"), key.alias("key"), F.lit(1).alias("kind"), "conv_id",
                       F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("nbytes"), F.col("n_convs").alias("n"),
                       F.lit(False).alias("ended"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"),
                       F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("ends"), F.lit(False).alias("under_light"))


def heavy_ends(rows: DataFrame) -> DataFrame:
    """``key, ends`` of heavy nodes: ids in order, joined in rows of ``ENDS_ROWS`` where
    they are sorted by range, then hashed a node at a time as they stream by."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end - at < ENDS_ROWS:
                    end += 1
                yield _batch("key binary, first long, ids string", [(keys[at], ids[at], ",".join(map(str, ids[at:end])))])
                at = end

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = said = None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        yield _batch("key binary, ends string", [(now, said.hexdigest())])
                    now, said = key, hashlib.sha256(ids.encode())
                else:
                    said.update(b"," + ids.encode())
        if now is not None:
            yield _batch("key binary, ends string", [(now, said.hexdigest())])

    ids = rows.where("ended").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = map_arrow(ids, join, "key binary, first long, ids string")
    return map_arrow(parts.repartition("key").sortWithinPartitions("key", "first"), digest, "key binary, ends string")


def trie(conversations: DataFrame, family: int = FAMILY, queue_rows: int = QUEUE_ROWS, levels: int = BAND,
         min_heavy: int = MIN_HEAVY) -> DataFrame:
    """A row for each node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    A ``family`` of 1 takes the conversations as they are."""
    spark = conversations.sparkSession
    turns = _written(sorted_turns(conversations, family, levels), "trie-turns")
    pieces = _written(paths(turns, levels), "trie-paths")
    n_turns = turns.agg(F.sum(F.octet_length("x") / 16)).first()[0] or 0
    often = max(min_heavy, int(n_turns) // MOST_HEAVY)
    popular = [r.key for r in node_keys(pieces).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > often)
               .select("key").collect()]  # at most 9 * MOST_HEAVY: members of all nodes are turns
    heavy = spark.sparkContext.broadcast(frozenset(map(bytes, popular)) | {_key(ROOT)})

    deepest = pieces.agg(F.max(F.col("depth") + F.octet_length("keys") / 16 - 1)).first()[0] or 0
    nodes, tops, sent = [], [], None
    for band in range(max(int(deepest) - 1, 0) // levels, -1, -1):
        rows = members(pieces, heavy, True, band, levels)
        if sent is not None:
            homes = rows.where(F.col("depth") == (band + 1) * levels).select(F.col("key").alias("home"), "unit").distinct()
            rows = rows.unionByName(_messages(sent.join(homes, F.col("parent") == F.col("home")), F.col("unit"), F.col("parent")))
        done = _process(rows.repartition("unit"), queue_rows)
        nodes.append(done.where("NOT top"))
        tops.append(done.where("top AND NOT under_light"))
        sent = done.where("top AND under_light")

    own = members(pieces, heavy, False)
    known = own.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("nbytes").alias("nbytes"),
                                   F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    known = _written(known.join(heavy_ends(own), "key", "left"), "trie-heavy")  # at most 9 * MOST_HEAVY rows
    hanging = tops[0]
    for more in tops[1:]:
        hanging = hanging.unionByName(more)
    given = hanging.groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    empty = hashlib.sha256().hexdigest()
    rows = known.join(given, "key", "left").select(
        F.lit(_key(ROOT)).alias("unit"), "depth", "key", F.lit(0).alias("kind"), "conv_id", "parent", "nbytes", "n",
        F.lit(False).alias("ended"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")],
        F.coalesce("ends", F.lit(empty)).alias("ends"), F.lit(False).alias("under_light"))
    done = _process(rows.coalesce(1), queue_rows)
    ids = F.broadcast(known.select(F.col("key").alias("parent"), F.col("conv_id").alias("of")))
    nodes += [done, hanging.join(ids, "parent", "left").withColumn("parent_conv_id", F.col("of"))]
    columns = [f.split()[0] for f in TOTALS.split(", ")[:8]]
    result = nodes[0].select(columns)
    for more in nodes[1:]:
        result = result.unionByName(more.select(columns))
    return result
