"""MOD4: random forest of classification trees over sparse rows.

Spark's own forest lays each training row out densely and shuffles a whole histogram of
each node of a batch from every partition.  Here a row stays its non-zero features with
their bins, and only cells that occur are counted:

* bins are those of ``boosting``: quantiles of a feature's values above zero, zero below all;
* a tree takes each row as often as a Poisson draw of mean 1 says (a bootstrap sample);
* a node may split by ``ceil(sqrt(features))`` of them, drawn without replacement;
* all trees grow level by level.  A level is one job: a task leads its rows down the trees so
  far and counts classes by open node, feature of the node's draw and bin; the counts cross
  one shuffle, and the task that gets a node's finds the split that lowers the Gini impurity
  of the weighted classes most.  The driver gets a split a node.

Nothing but the packed rows is kept on executors.  A few rows at a time are laid out for
looking bins up (``CHUNK_BYTES``), so a task's memory depends on its rows' non-zeros.  A
prediction is the first maximum of the trees' summed leaf distributions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import scores as SC
from moodspark.operators.blocks import vector_parts
from moodspark.operators.boosting import LEAF, MAX_CLASSES, bin_edges, cells_of
from moodspark.operators.joins import collect_bounded
from moodspark.session import ship_package

BLOCK = "id long, labels binary, starts binary, features binary, bins binary"
COUNTS = "part int, cells binary, counts binary"
SPLITS = "nodes binary, features binary, cuts binary, totals binary, above binary"
#: Bytes of the rows that are laid out at once, and looked-up bins at once.
CHUNK_BYTES, LOOKUPS = 16_000_000, 1_000_000
#: Draws of features that nodes take theirs from.
POOL = 16_384
#: Counts that a task holds before it adds up equal cells.
HELD = 4_000_000
#: Partitions of rows whose counts go to one task.
FAN = 4


def feature_draws(size: int, seed: int, n: int = POOL) -> np.ndarray:
    """``n`` draws of ``ceil(sqrt(size))`` features without replacement, in ascending order."""
    m = max(1, int(np.ceil(np.sqrt(size))))
    rnd, out = np.random.default_rng(seed), np.empty((n, m), np.int32)
    each = size // m  # draws that one permutation gives
    for at in range(0, n, each):
        part = rnd.permutation(size)[:each * m].reshape(each, m)[:n - at]
        out[at:at + each] = np.sort(part, 1)
    return out


def draw_of(tree: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The draw of the node at ``place`` (root 1, children 2i and 2i + 1) of each tree."""
    x = np.array(tree, np.uint64) * np.uint64(1 << 40) + np.array(place, np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(POOL)).astype(np.int64)


def draws_of_rows(id_: int, n: int, trees: int, seed: int) -> np.ndarray:
    """How often each tree takes each row of a block: a bootstrap sample."""
    return np.random.default_rng([seed, id_]).poisson(1.0, (n, trees)).astype(np.uint8)


def packed(df: DataFrame, label_col: str, features_col: str, first: np.ndarray, edges: np.ndarray) -> DataFrame:
    """One row (``BLOCK``) for each Arrow batch of training rows, its non-zeros as bins."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((first, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (list_value_length)

        for i, b in enumerate(batches):
            if b.num_rows:
                starts, features, bins = binned_rows(b.column(1), *sent.value)
                parts = (b.column(0).to_numpy(zero_copy_only=False).astype(np.int16), starts, features, bins)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() * 2 ** 32 + i], pa.int64())]
                                                 + [pa.array([p.tobytes()], pa.binary()) for p in parts],
                                                 [f.split()[0] for f in BLOCK.split(", ")])

    return df.select(F.col(label_col).cast("int").alias("label"), features_col).mapInArrow(run, BLOCK)


def binned_rows(vectors: pa.Array, first: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, features, bins`` of the non-zeros (a bin is 1 or more) of feature vectors."""
    starts, indices, values, _ = vector_parts(vectors)
    if (values < 0).any():
        raise ValueError("the forest needs features that aren't negative")
    own = (values > 0) & (first[indices + 1] > first[indices])
    bins = (cells_of(indices[own], values[own], first, edges) - first[indices[own]] + 1).astype(np.uint8)
    return np.append(0, np.cumsum(own))[starts].astype(np.int64), indices[own].astype(np.int32), bins


def laid_out(starts: np.ndarray, features: np.ndarray, bins: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """A few rows at a time: the first one's number, and bins by row and feature."""
    step = max(1, CHUNK_BYTES // max(size, 1))
    for a in range(0, len(starts) - 1, step):
        own = starts[a:a + step + 1]
        out = np.zeros((len(own) - 1, max(size, 1)), np.uint8)
        rows = np.repeat(np.arange(len(own) - 1), np.diff(own))
        out[rows, features[own[0]:own[-1]]] = bins[own[0]:own[-1]]
        yield a, out


def led_down(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The nodes without a split where ``rows`` arrive from ``node``."""
    flat, base = bins.ravel(), rows * bins.shape[1]
    live = np.flatnonzero(feature[node] != LEAF)
    while len(live):
        at = node[live]
        at = left[at] + (flat[base[live] + feature[at]] > cut[at])
        node[live] = at
        live = live[feature[at] != LEAF]
    return node


def _added(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cells, each once, and their counts."""
    cell, count = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    return cell[at], np.add.reduceat(count, at) if len(at) else count


class Level:
    """The trees so far and the nodes to split: node ``i`` of all has the split ``feature, cut``
    (above it: ``left + 1``) or none, and is the ``open_[i]``-th to split or ``LEAF``."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, open_: np.ndarray, draws: np.ndarray,
                 trees: int, classes: int, n_bins: int, seed: int):
        self.feature, self.cut, self.left, self.open_, self.draws = feature, cut, left, open_, draws
        self.trees, self.classes, self.n_bins, self.seed = trees, classes, n_bins, seed

    def counted(self, blocks: Iterator[tuple], pool: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells (node, feature of its draw, bin, class) of the rows in ``blocks`` and their counts;
        a node's classes as a whole stand after its last feature."""
        m = pool.shape[1]
        wide = (m + 1) * self.n_bins * self.classes
        cells, counts, held = [], [], 0
        for id_, labels, starts, features, bins in blocks:
            times_drawn = draws_of_rows(id_, len(labels), self.trees, self.seed)
            for a, out in laid_out(starts, features, bins, size):
                drawn = times_drawn[a:a + len(out)]
                row, tree = np.nonzero(drawn)
                node = self.open_[led_down(out, row, tree.astype(np.int64), self.feature, self.cut, self.left)]
                own = np.flatnonzero(node != LEAF)
                row, node, times = row[own], node[own].astype(np.int64), drawn[row[own], tree[own]].astype(np.int64)
                label = labels[a + row].astype(np.int64)
                cells.append(node * wide + m * self.n_bins * self.classes + label)
                counts.append(times)
                flat, step = out.ravel(), max(1, LOOKUPS // m)
                for b in range(0, len(own), step):
                    s = slice(b, b + step)
                    found = flat[pool[self.draws[node[s]]] + (row[s] * size)[:, None]].ravel()
                    hit = np.flatnonzero(found)
                    of, slot = np.divmod(hit, m)
                    of += b
                    cells.append(node[of] * wide + (slot * self.n_bins + found[hit]) * self.classes + label[of])
                    counts.append(times[of])
                    held += len(hit)
                if held > HELD:
                    cells, counts = ([x] for x in _added(cells, counts))
                    held = 0
        return _added(cells, counts) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def splits(self, cells: np.ndarray, counts: np.ndarray, pool: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """``nodes, features, cuts, totals, above``: each node's best split (feature ``LEAF``: none lowers
        the impurity), its rows by class and those above the cut; the first feature and cut of equals."""
        m, k = pool.shape[1], self.classes
        cell, cls = np.divmod(cells, k)
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        by = np.zeros((len(at), k), np.int64)
        by[np.repeat(np.arange(len(at)), np.diff(np.append(at, len(cell)))), cls] = counts
        rest, bin_ = np.divmod(cell[at], self.n_bins)
        node, slot = np.divmod(rest, m + 1)
        whole = slot == m
        nodes, totals = node[whole], by[whole]
        rest, bin_, node, slot, by = (x[~whole] for x in (rest, bin_, node, slot, by))
        feature, cut, above = np.full(len(nodes), LEAF, np.int32), np.zeros(len(nodes), np.uint8), np.zeros_like(totals)
        if len(rest):
            # bins from this one on against those before it, and zero
            new = np.append(True, rest[1:] != rest[:-1])
            end = np.append(np.flatnonzero(new)[1:], len(rest)) - 1
            cum = np.cumsum(by, 0)
            up = cum[end[np.cumsum(new) - 1]] - cum + by
            before = np.where(new, 0, np.append(0, bin_[:-1]))
            of = np.searchsorted(nodes, node)
            total, low = totals[of], totals[of] - up

            def impurity(n: np.ndarray) -> np.ndarray:
                """Gini impurity times weight."""
                n = n * weights
                s = n.sum(1)
                return s - (n * n).sum(1) / np.maximum(s, 1e-300)

            gain = (impurity(total) - impurity(up) - impurity(low)) / (total * weights).sum(1)
            gain = np.where(low.sum(1) > 0, gain, -1.0)
            best = np.lexsort((np.arange(len(gain)), -gain, node))
            best = best[np.append(True, node[best][1:] != node[best][:-1])]
            best = best[gain[best] > 1e-12]
            feature[of[best]] = pool[self.draws[node[best]], slot[best]]
            cut[of[best]], above[of[best]] = before[best], up[best]
        return nodes, feature, cut, totals, above


def _deltas(cells: np.ndarray) -> np.ndarray:
    """Ascending cells as steps, small numbers that compress well."""
    steps = np.diff(cells, prepend=0)
    return steps.astype(np.uint32) if not len(steps) or steps.max() < 2 ** 32 else steps.astype(np.uint64)


def best_splits(blocks: DataFrame, partitions: int, level: Level, shared, size: int, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """``Level.splits`` of all rows; ``shared`` is the broadcast pool of draws."""
    n_open = len(level.draws)
    parts = max(1, min(n_open, -(-partitions // FAN)))
    sent = blocks.sparkSession.sparkContext.broadcast((level, (np.arange(1, parts) * n_open) // parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, ends = sent.value
        kinds = (np.int16, np.int64, np.int32, np.uint8)
        rows = ((b.column(0)[i].as_py(), *[np.frombuffer(b.column(c + 1)[i].as_buffer(), t) for c, t in enumerate(kinds)])
                for b in batches for i in range(b.num_rows))
        cells, counts = level.counted(rows, shared.value, size)
        wide = (shared.value.shape[1] + 1) * level.n_bins * level.classes
        at = [0, *np.searchsorted(cells, ends * wide), len(cells)]
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b > a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([_deltas(cells[a:b]).tobytes()], pa.binary()),
                     pa.array([counts[a:b].astype(np.uint32).tobytes()], pa.binary())], [f.split()[0] for f in COUNTS.split(", ")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value[0]
        held: dict[int, list] = {}
        for b in batches:
            for part, cells, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                n = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
                steps = np.frombuffer(cells.as_buffer(), np.uint32 if cells.as_buffer().size == 4 * len(n) else np.uint64)
                held.setdefault(part, []).append((np.cumsum(steps.astype(np.int64)), n))
        for found in held.values():
            out = level.splits(*_added(*zip(*found)), shared.value, weights)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], [f.split()[0] for f in SPLITS.split(", ")])

    try:
        rows = blocks.mapInArrow(count, COUNTS).repartition(parts, "part").mapInArrow(split, SPLITS).toArrow()
    finally:
        sent.destroy()
    kinds = (np.int64, np.int32, np.uint8, np.int64, np.int64)
    out = [np.concatenate([np.frombuffer(v.as_buffer(), t) for v in c]) for c, t in zip(rows.columns, kinds)]
    order = np.argsort(out[0])
    return tuple(x.reshape(len(order), -1)[order].squeeze(1) if i < 3 else x.reshape(len(order), -1)[order] for i, x in enumerate(out))


def grow(find, trees: int, classes: int, n_bins: int, depth: int, seed: int) -> tuple[np.ndarray, ...]:
    """``feature, cut, left, counts`` of all nodes, the trees' roots first; ``find(level)`` gives ``Level.splits``."""
    feature, cut, left = np.full(trees, LEAF, np.int32), np.zeros(trees, np.uint8), np.zeros(trees, np.int64)
    counts = np.zeros((trees, classes), np.int64)
    open_, tree, place = np.arange(trees), np.arange(trees), np.ones(trees, np.int64)
    for level in range(depth):
        if not len(open_):
            break
        at = np.full(len(feature), LEAF, np.int32)
        at[open_] = np.arange(len(open_))
        nodes, f, c, totals, above = find(Level(feature, cut, left, at, draw_of(tree, place, seed), trees, classes, n_bins, seed))
        if not level:
            counts[open_[nodes]] = totals  # a tree that drew no row has none
        own = f != LEAF
        nodes, f, c, totals, above = (x[own] for x in (nodes, f, c, totals, above))
        here, new = open_[nodes], len(feature) + 2 * np.arange(len(nodes))
        feature[here], cut[here], left[here] = f, c, new
        children = np.stack([totals - above, above], 1).reshape(-1, classes)
        feature = np.append(feature, np.full(len(children), LEAF, np.int32))
        cut, left = np.append(cut, np.zeros(len(children), np.uint8)), np.append(left, np.zeros(len(children), np.int64))
        counts = np.concatenate([counts, children])
        mixed = (children > 0).sum(1) > 1
        open_ = (len(feature) - len(children) + np.arange(len(children)))[mixed]
        tree = np.repeat(tree[nodes], 2)[mixed]
        place = (np.repeat(place[nodes] * 2, 2) + np.tile([0, 1], len(nodes)))[mixed]
    return feature, cut, left, counts


class _ForestParams(HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol):
    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, zero's included", typeConverter=TypeConverters.toInt)


class RandomForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Labels 0, 1, ...; ``weightCol`` holds a weight for each class."""

    @keyword_only
    def __init__(self, numTrees=20, maxDepth=5, maxBins=32, seed=0, weightCol=None, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, maxBins=32, seed=0, featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "RandomForestModel":
        g = self.getOrDefault
        label, features = g(self.labelCol), g(self.featuresCol)
        if not 2 <= g(self.maxBins) <= 256:
            raise ValueError("maxBins is 2 to 256")
        weight = F.col(g(self.weightCol)) if self.isDefined(self.weightCol) else F.lit(1.0)
        by = collect_bounded(dataset.groupBy(F.col(label).cast("int").alias("c")).agg(
            F.min(weight).alias("low"), F.max(weight).alias("high")), MAX_CLASSES, "classes")
        if not by:
            raise ValueError("a fit needs training rows")
        if any(r.low != r.high for r in by):
            raise ValueError("rows of one class have different weights")
        k = max(2, max(r.c for r in by) + 1)
        weights = np.ones(k)
        weights[[r.c for r in by]] = [r.low for r in by]
        size = len(dataset.select(features).first()[0])
        first, edges = bin_edges(dataset, features, size, g(self.maxBins) - 1)
        blocks = packed(dataset, label, features, first, edges).persist()
        shared = dataset.sparkSession.sparkContext.broadcast(feature_draws(size, g(self.seed)) if size else np.zeros((POOL, 1), np.int32))
        try:
            partitions = blocks.rdd.getNumPartitions()
            grown = grow(lambda level: best_splits(blocks, partitions, level, shared, max(size, 1), weights),
                         g(self.numTrees), k, g(self.maxBins), g(self.maxDepth), g(self.seed))
        finally:
            blocks.unpersist()
            shared.destroy()
        feature, cut, left, counts = grown
        leaf = counts * weights
        leaf = leaf / np.maximum(leaf.sum(1, keepdims=True), 1e-300)
        model = RandomForestModel({"first": first, "edges": edges, "feature": feature, "cut": cut, "left": left, "leaf": leaf}, g(self.numTrees))
        return self._copyValues(model)


#: Arrays of a model, and bytes of them in a row of its file.
KINDS = {"first": np.int64, "edges": np.float64, "feature": np.int32, "cut": np.uint8, "left": np.int64, "leaf": np.float64}
ROW_BYTES = 4_000_000


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        i = self.instance
        DefaultParamsWriter.saveMetadata(i, path, self.sparkSession, extraMetadata={"trees": i.trees, "classes": i.arrays["leaf"].shape[1]})
        rows = [(name, at, data[at:at + ROW_BYTES]) for name, kind in KINDS.items()
                for data in [np.ascontiguousarray(i.arrays[name], kind).tobytes()] for at in range(0, len(data), ROW_BYTES)]
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["name", "at", "data"])
        self.sparkSession.createDataFrame(table).write.parquet(f"{path}/arrays")


class _ModelReader(MLReader):
    def load(self, path: str) -> "RandomForestModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = self.sparkSession.read.parquet(f"{path}/arrays").orderBy("name", "at").collect()
        arrays = {name: np.frombuffer(b"".join(bytes(r.data) for r in parts if r.name == name), kind) for name, kind in KINDS.items()}
        arrays["leaf"] = arrays["leaf"].reshape(-1, metadata["classes"])
        out = RandomForestModel(arrays, metadata["trees"])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class RandomForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """Adds ``rawPrediction`` (summed leaf distributions), ``probability`` and ``prediction``."""

    def __init__(self, arrays=None, trees=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")
        self.arrays, self.trees, self._sent = arrays or {}, trees, None

    def write(self):
        return _ModelWriter(self)

    @classmethod
    def read(cls):
        return _ModelReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        if self._sent is None:  # one broadcast for all that a model scores
            self._sent = dataset.sparkSession.sparkContext.broadcast(self.arrays)
        sent, trees = self._sent, self.trees

        def score(vectors: pa.Array) -> pa.Array:
            import pyarrow.compute  # noqa: F401
            return score_vectors(vectors, sent.value, trees)

        raw = F.arrow_udf(score, "array<double>")(F.col(self.getOrDefault(self.featuresCol)))
        out = dataset.withColumn("_raw", raw)
        total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("rawPrediction", array_to_vector("_raw"))
                .withColumn("probability", array_to_vector(F.transform("_raw", lambda v: v / F.greatest(total, F.lit(1e-300)))))
                .withColumn("prediction", SC.argmax("_raw").cast("double")).drop("_raw"))


def score_vectors(vectors: pa.Array, arrays: dict[str, np.ndarray], trees: int) -> pa.Array:
    """The sum over the trees of the class distributions of the leaves that each row of a batch reaches."""
    first, leaf = arrays["first"], arrays["leaf"]
    n, k = len(vectors), leaf.shape[1]
    total = np.zeros((n, k))
    for a, bins in laid_out(*binned_rows(vectors, first, arrays["edges"]), len(first) - 1):
        rows = np.repeat(np.arange(len(bins)), trees)
        node = led_down(bins, rows, np.tile(np.arange(trees), len(bins)), arrays["feature"], arrays["cut"], arrays["left"])
        total[a:a + len(bins)] = leaf[node].reshape(len(bins), trees, k).sum(1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(total.ravel()))
