"""Feature rows packed into blocks, and sums of arrays over blocks.

An own solver passes over the training rows many times.  ``pack`` turns feature
vectors into a few binary columns per Arrow batch once, so that a pass moves no
single rows; ``tree_sum`` applies a function to each block and adds up the arrays
it returns: within a task, then by ``FAN`` partial sums at a time, so that the
driver never receives more than ``FAN`` arrays, whatever the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.session import ship_package

FAN = 16
#: Parts from this length on are multiplied one by one where there are so many columns; shorter ones by so many values at once.
LONG, WIDE, STEP = 64, 4, 16_384
#: Non-zeros from which on blocks aren't joined.
JOINED = 4_000_000
BLOCK = "n long, size long, labels binary, starts binary, indices binary, values binary"
JOINED_BLOCK = BLOCK + ", features binary, feature_starts binary, feature_rows binary, feature_values binary"


class Block:
    """Rows in compressed sparse form: row ``i`` is ``indices/values[starts[i]:starts[i+1]]``; and
    the same by feature, the most frequent first, which is worked out where it isn't given."""

    def __init__(self, labels: np.ndarray, starts: np.ndarray, indices: np.ndarray, values: np.ndarray, size: int,
                 *by_feature: np.ndarray):
        self.labels, self.starts, self.indices, self.values, self.size = labels, starts, indices, values, size
        self._by_feature = by_feature

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> "Block":
        n, size, *parts = (c[i] for c in batch.columns)
        kinds = (np.float64, np.int64, np.int32, np.float64, np.int32, np.int64, np.int32, np.float64)
        labels, starts, indices, values, *rest = (np.frombuffer(p.as_buffer(), k) for p, k in zip(parts, kinds))
        return cls(labels, starts, indices, values, size.as_py(), *rest)

    @classmethod
    def joined(cls, blocks: list["Block"]) -> "Block":
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.starts) for b in blocks]))])
        return cls(np.concatenate([b.labels for b in blocks]), starts.astype(np.int64), np.concatenate([b.indices for b in blocks]),
                   np.concatenate([b.values for b in blocks]), max(b.size for b in blocks))

    @property
    def by_feature(self) -> tuple[np.ndarray, ...]:
        """``features, starts, rows, values``."""
        if not self._by_feature:
            times = np.bincount(self.indices, minlength=self.size)
            features = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
            place = np.zeros(self.size, np.int32)
            place[features] = np.arange(len(features))
            order = np.argsort(place[self.indices], kind="stable")
            rows = np.repeat(np.arange(len(self.labels), dtype=np.int32), np.diff(self.starts))
            self._by_feature = (features.astype(np.int32), np.append(0, np.cumsum(times[features])).astype(np.int64),
                                rows[order], self.values[order])
        return self._by_feature

    def dot(self, w: np.ndarray) -> np.ndarray:
        """``rows x problems`` products with ``problems x (size + 1)`` weights, the last a constant's."""
        return sums_of_parts(self.starts, self.indices, self.values, np.ascontiguousarray(w[:, :-1].T)) + w[:, -1]

    def transposed_dot(self, r: np.ndarray) -> np.ndarray:
        """``problems x (size + 1)`` sums over rows, weighted by ``rows x problems``."""
        out = np.zeros((r.shape[1], self.size + 1))
        features, starts, rows, values = self.by_feature
        out[:, features] = sums_of_parts(starts, rows, values, np.ascontiguousarray(r)).T
        out[:, -1] = r.sum(0)
        return out


def sums_of_parts(starts: np.ndarray, at: np.ndarray, values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each part of ``at`` and ``values`` the sum of the table's rows ``at``, times the values."""
    n, k = len(starts) - 1, table.shape[1]
    out, lengths = np.zeros((n, k)), np.diff(starts)
    long = lengths >= LONG if k >= WIDE else np.zeros(n, bool)
    ends = starts.tolist()
    for i in np.flatnonzero(long).tolist():  # a product each
        a, b = ends[i], ends[i + 1]
        np.dot(values[a:b], table.take(at[a:b], 0), out=out[i])
    short = np.flatnonzero(~long & (lengths > 0))
    if long.any() and len(short):
        own = np.repeat(~long, lengths)
        at, values = at[own], values[own]
    bounds = np.append(0, np.cumsum(lengths[short]))
    i = 0
    while i < len(short):  # many together
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + STEP, "right")) - 1)
        terms = table.take(at[bounds[i]:bounds[j]], 0)
        terms *= values[bounds[i]:bounds[j], None]
        out[short[i:j]] = np.add.reduceat(terms, bounds[i:j] - bounds[i], 0)
        i = j
    return out


def vector_parts(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``starts, indices, values, size`` of a batch of feature vectors, sparse or dense."""
    if isinstance(vectors, pa.ExtensionArray):
        vectors = vectors.storage
    if not len(vectors):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    kind = vectors.field(0).to_numpy(zero_copy_only=False)
    held = [vectors.field(i) for i in (2, 3)]
    lengths = np.array(pa.compute.list_value_length(held[1]).to_pylist(), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    values = np.asarray(held[1].flatten(), np.float64)
    if (kind == 0).all():
        return starts, np.asarray(held[0].flatten(), np.int64), values, int(vectors.field(1)[0].as_py())
    indices = [np.arange(n) if k else np.array(i, np.int64) for k, i, n in zip(kind, held[0].to_pylist(), lengths)]
    size = int(lengths[kind == 1][0])
    return starts, np.concatenate(indices), values, size


def pack(df: DataFrame, label_col: str = "label", features_col: str = "features", rows: int | None = None) -> DataFrame:
    """One row for each Arrow batch of training rows; with ``rows``, dealt out to
    partitions of about so many rows each (rows of small partitions are packed where
    they are, and their blocks dealt out)."""
    ship_package(df.sparkSession)
    df = df.select(F.col(label_col).cast("double").alias("label"), features_col)
    parts = max(1, -(-df.count() // rows)) if rows else None
    whole = parts and df.rdd.getNumPartitions() < parts
    if whole:
        df = df.repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (list_value_length)

        for b in batches:
            if b.num_rows:
                starts, indices, values, size = vector_parts(b.column(1))
                parts = (b.column(0).to_numpy(zero_copy_only=False).astype(np.float64), starts.astype(np.int64), indices.astype(np.int32), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int64()), pa.array([size], pa.int64())]
                    + [pa.array([p.tobytes()], pa.binary()) for p in parts], [f.split()[0] for f in BLOCK.split(", ")])

    blocks = df.mapInArrow(run, BLOCK)
    return blocks.repartition(parts) if parts and not whole else blocks


def joined(blocks: DataFrame) -> DataFrame:
    """The blocks of a partition joined to larger ones, by feature as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            b = Block.joined(held)
            parts = (b.labels, b.starts, b.indices, b.values, *b.by_feature)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(b.labels)], pa.int64()), pa.array([b.size], pa.int64())]
                + [pa.array([p.tobytes()], pa.binary()) for p in parts], [f.split()[0] for f in JOINED_BLOCK.split(", ")])

        for b in batches:
            for i in range(b.num_rows):
                held.append(Block.of(b, i))
                n += len(held[-1].values)
                if n >= JOINED:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return blocks.mapInArrow(run, JOINED_BLOCK)


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def tree_sum(blocks: DataFrame, part: Callable[[pa.RecordBatch, int], np.ndarray], partitions: int, fan: int = FAN) -> np.ndarray:
    """The sum of ``part(batch, row)`` over all rows of ``blocks``; every array has the same length."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                v = part(b, i)
                total = v if total is None else total + v
        if total is not None:
            yield _row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                v = np.frombuffer(v.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield _row(total)

    sums = blocks.mapInArrow(first, "v binary")
    while partitions > fan:
        partitions = -(-partitions // fan)
        sums = sums.repartition(partitions).mapInArrow(add, "v binary")
    total = None
    for v in sums.toArrow().column(0):  # at most ``fan`` rows
        v = np.frombuffer(v.as_buffer(), np.float64)
        total = v if total is None else total + v
    return total
