"""MOD5: multi-class gradient boosting, K trees a round on shared soft-max residuals.

Features are binned once: edges per feature are quantiles of its values above zero,
and a feature's cells are its bins.  Training rows become blocks sorted by cell, so
that the rows above a threshold are one slice.  A round grows a tree for each class,
level by level; a level is one job in which every block works out its rows' scores
from the trees so far, their residuals and nodes, and a histogram (sums of residuals
and counts by class, node and cell) of each open node.  Histograms are cut into chunks
of whole features and added up chunk by chunk where the chunk is dealt to, which also
finds each node's best split in it; the driver picks from one candidate a chunk, class
and node.  A leaf's value is one Newton step.

Nothing is kept on executors but the blocks: scores are worked out anew from the model,
so a lost executor costs its blocks alone.  A task's histogram takes 16 bytes for each
class, open node and cell (features times bins at most, and only bins that occur): the
vocabulary and ``maxBins`` bound it.

Features must not be negative (TF-IDF isn't): zeros are below every edge.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import scores as SC
from moodspark.operators.blocks import pack, tree_sum, vector_parts
from moodspark.operators.joins import collect_bounded
from moodspark.session import ship_package

MAX_CLASSES = 100
BINNED = "n long, labels binary, cells binary, rows binary"
FOUND = "class int, node long, gain double, low long, high long"
LEAF = -1
#: Cells of a chunk of histograms, about: a chunk ends where a feature does.
CHUNK = 16_384


def bin_edges(df: DataFrame, features_col: str, size: int, max_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``first, edges``: feature ``f`` has the ascending edges ``edges[first[f]:first[f + 1]]``,
    its largest value last; quantiles are exact up to a sketch's accuracy."""
    at = F.array(*[F.lit((i + 1) / max_bins) for i in range(max_bins)])
    held = df.select(F.explode(_above_zero(F.col(features_col))).alias("col"))
    found = (held.select("col.f", "col.x").where("x > 0").groupBy("f")
             .agg(F.array_sort(F.array_distinct(F.percentile_approx("x", at, 1000))).alias("e")))
    by = {r.f: r.e for r in collect_bounded(found, size, "features")}
    edges = [np.array(by.get(f, []), float) for f in range(size)]
    return np.concatenate([[0], np.cumsum([len(e) for e in edges])]).astype(np.int64), np.concatenate(edges or [np.zeros(0)])


def _above_zero(features):
    def parts(vectors: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401
        starts, indices, values, _ = vector_parts(vectors)
        pairs = pa.StructArray.from_arrays([pa.array(indices.astype(np.int32)), pa.array(values)], ["f", "x"])
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pairs)

    return F.arrow_udf(parts, "array<struct<f:int,x:double>>")(features)


def cells_of(indices: np.ndarray, values: np.ndarray, first: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The first edge that isn't below each value (a feature's last if all are), by halving."""
    low, high = first[indices], first[indices + 1] - 1
    while (low < high).any():
        mid = (low + high) // 2
        up = edges[mid] < values
        low, high = np.where(up & (low < high), mid + 1, low), np.where(up, high, np.minimum(high, mid))
    return low


def binned(blocks: DataFrame, first: np.ndarray, edges: np.ndarray) -> DataFrame:
    """Blocks sorted by cell; a value is in the bin of the first edge that isn't below it
    (beyond the last edge: in the last)."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((first, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, edges = sent.value
        for b in batches:
            for i in range(b.num_rows):
                labels, starts, indices, values = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in
                                                   ((2, np.float64), (3, np.int64), (4, np.int32), (5, np.float64)))
                if (values < 0).any():
                    raise ValueError("boosting needs features that aren't negative")
                rows = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(starts))
                own = (values > 0) & (first[indices + 1] > first[indices])
                indices, values, rows = indices[own], values[own], rows[own]
                low = cells_of(indices, values, first, edges)
                order = np.argsort(low, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(labels)], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in
                                                             (labels, low[order].astype(np.int64), rows[order])],
                    [f.split()[0] for f in BINNED.split(", ")])

    return blocks.mapInArrow(run, BINNED)


class Tree:
    """Node ``i`` has children 2i + 1 (at most the threshold) and 2i + 2 (above); ``low[i]``
    and ``high[i]`` are the cells above a split's threshold, or ``LEAF``."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.low, self.high = np.full(n, LEAF, np.int64), np.full(n, LEAF, np.int64)
        self.value = np.zeros(n)

    def nodes(self, n: int, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(n, np.int64)
        for i in np.flatnonzero(self.low != LEAF):  # parents come before their children
            above = np.zeros(n, bool)
            above[rows[np.searchsorted(cells, self.low[i]):np.searchsorted(cells, self.high[i])]] = True
            node = np.where(node == i, 2 * i + 1 + above, node)
        return node


def _softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Rows:
    """One block's rows under a model: probabilities and residuals."""

    def __init__(self, batch: pa.RecordBatch, i: int, start: np.ndarray, rounds: list[list[Tree]], rate: float):
        labels, self.cells, self.rows = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in
                                         ((1, np.float64), (2, np.int64), (3, np.int32)))
        self.n = len(labels)
        f = np.tile(start, (self.n, 1))
        for trees in rounds:
            for k, tree in enumerate(trees):
                f[:, k] += rate * tree.value[tree.nodes(self.n, self.cells, self.rows)]
        self.p = _softmax(f)
        hit = labels.astype(int)[:, None] == np.arange(len(start))[None]
        self.r = hit - self.p
        self.loss = -np.log(np.maximum(self.p[hit], 1e-300)).sum()

    def histograms(self, trees: list[Tree], open_: list[np.ndarray], n_cells: int) -> list[tuple[np.ndarray, ...]]:
        """For each class: sums of residuals and counts by open node and cell, and by open node."""
        out = []
        for k, (tree, nodes) in enumerate(zip(trees, open_)):
            slot, m = np.full(len(tree.low), LEAF), len(nodes)
            slot[nodes] = np.arange(m)
            at = slot[tree.nodes(self.n, self.cells, self.rows)]
            inside = at >= 0
            held = at[self.rows]
            place = (held * n_cells + self.cells)[held >= 0]
            out.append((np.bincount(place, self.r[self.rows[held >= 0], k], m * n_cells).reshape(m, n_cells),
                        np.bincount(place, minlength=m * n_cells).astype(float).reshape(m, n_cells),
                        np.bincount(at[inside], self.r[inside, k], m), np.bincount(at[inside], minlength=m).astype(float)))
        return out

    def leaves(self, trees: list[Tree]) -> np.ndarray:
        out = [[self.loss, self.n]]
        for k, tree in enumerate(trees):
            node, n = tree.nodes(self.n, self.cells, self.rows), len(tree.low)
            out += [np.bincount(node, self.r[:, k], n), np.bincount(node, self.p[:, k] * (1 - self.p[:, k]), n)]
        return np.concatenate(out)


def best_split(g: np.ndarray, c: np.ndarray, total_g: float, total_c: float, first: np.ndarray) -> tuple[float, int, int] | None:
    """The gain and the cells above the threshold that lowers the squared error most; the first of equals."""
    ends = np.repeat(first[1:], np.diff(first))  # a cell's feature's end
    if not len(ends):
        return None
    sum_g, sum_c = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(c))
    here = np.arange(len(ends))
    above_g, above_c = sum_g[ends] - sum_g[here], sum_c[ends] - sum_c[here]
    below_g, below_c = total_g - above_g, total_c - above_c
    ok = (above_c > .5) & (below_c > .5)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, above_c * below_c / total_c * (above_g / above_c - below_g / below_c) ** 2, -1)
    # gains that differ by rounding alone are equal
    best = int((gain >= gain.max() * (1 - 1e-9)).argmax())
    return (float(gain[best]), best, int(ends[best])) if gain[best] > 1e-12 else None


def chunk_ends(first: np.ndarray, size: int = CHUNK) -> np.ndarray:
    """Features at which chunks of about ``size`` cells begin, and the number of features."""
    ends, at = [0], 0
    while at < len(first) - 1:
        at = max(at + 1, int(np.searchsorted(first, first[at] + size, "right")) - 1)
        ends.append(at)
    return np.array(ends)


def chunk_splits(sums: list[tuple[np.ndarray, ...]], asked: list[np.ndarray], first: np.ndarray, a: int, b: int) -> list[tuple]:
    """``FOUND`` of the features from ``a`` to ``b``, given the histograms of their cells."""
    out, own = [], first[a:b + 1] - first[a]
    for k, (nodes, (g, c, total_g, total_c)) in enumerate(zip(asked, sums)):
        for j, node in enumerate(nodes):
            found = best_split(g[j], c[j], total_g[j], total_c[j], own)
            if found is not None:
                out.append((k, int(node), found[0], found[1] + int(first[a]), found[2] + int(first[a])))
    return out


def _flat(sums: list[tuple[np.ndarray, ...]], low: int, high: int) -> np.ndarray:
    return np.concatenate([x for g, c, tg, tc in sums for x in (g[:, low:high].ravel(), c[:, low:high].ravel(), tg, tc)])


def _shaped(flat: np.ndarray, asked: list[np.ndarray], n_cells: int) -> list[tuple[np.ndarray, ...]]:
    out, at = [], 0
    for nodes in asked:
        m = len(nodes)
        parts = np.split(flat[at:at + 2 * m * (n_cells + 1)], np.cumsum([m * n_cells, m * n_cells, m]))
        out.append((parts[0].reshape(m, n_cells), parts[1].reshape(m, n_cells), parts[2], parts[3]))
        at += 2 * m * (n_cells + 1)
    return out


def _added(parts: Iterator[list[tuple[np.ndarray, ...]]]) -> list[tuple[np.ndarray, ...]]:
    """The sum of blocks' histograms, in the first one's place."""
    total = None
    for part in parts:
        if total is None:
            total = part
        else:
            for mine, more in zip(total, part):
                for x, y in zip(mine, more):
                    x += y
    return total


def grow(splits, leaves, k: int, n_rounds: int, depth: int) -> tuple[list[list[Tree]], list[float]]:
    """The trees of each round, and the mean log-loss before each round.
    ``splits(rounds, trees, asked)`` gives ``FOUND`` of the nodes that each class asks for,
    by ascending cells; ``leaves(rounds, trees)`` sums ``_Rows.leaves`` over all blocks."""
    rounds: list[list[Tree]] = []
    losses = []
    for _ in range(n_rounds):
        trees = [Tree(depth) for _ in range(k)]
        asked = [np.zeros(1, np.int64) for _ in range(k)]
        for _ in range(depth):
            if not any(len(a) for a in asked):
                break
            best: dict[tuple, tuple] = {}
            for c, node, gain, low, high in splits(rounds, trees, asked):
                # as in a chunk: the first of those that differ by rounding alone
                if (c, node) not in best or gain * (1 - 1e-9) > best[c, node][0]:
                    best[c, node] = gain, low, high
            for (c, node), (_, low, high) in best.items():
                trees[c].low[node], trees[c].high[node] = low, high
            asked = [np.array(sorted(x for c, node in best if c == i for x in (2 * node + 1, 2 * node + 2)), np.int64) for i in range(k)]
        sums = leaves(rounds, trees)
        losses.append(sums[0] / sums[1])
        per = sums[2:].reshape(k, 2, -1)
        for tree, (r, h) in zip(trees, per):
            tree.value = np.where(h > 1e-150, (k - 1) / k * r / np.maximum(h, 1e-150), 0.0)
        rounds.append(trees)
    return rounds, losses


def grow_over(blocks: DataFrame, partitions: int, first: np.ndarray, start: np.ndarray, n_rounds: int, depth: int,
              rate: float) -> tuple[list[list[Tree]], list[float]]:
    """``grow`` with a job for each level; blocks of one partition are one task's in any
    case, so there all levels are one job."""
    sc, k, n_cells = blocks.sparkSession.sparkContext, len(start), int(first[-1])
    if partitions > 1:
        ends = chunk_ends(first)
        shared = sc.broadcast((first, ends))

        def splits(rounds: list, trees: list, asked: list) -> list[tuple]:
            sent = sc.broadcast((rounds, trees))

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                first, ends = shared.value
                rounds, trees = sent.value
                total = _added(_Rows(b, i, start, rounds, rate).histograms(trees, asked, n_cells)
                               for b in batches for i in range(b.num_rows))
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]) if total is not None else []):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([_flat(total, first[a], first[b]).tobytes()], pa.binary())], ["chunk", "v"])

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                first, ends = shared.value
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for chunk, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                        v = np.frombuffer(v.as_buffer(), np.float64)
                        if chunk in total:
                            total[chunk] += v
                        else:
                            total[chunk] = v.copy()
                found = [x for i, v in total.items() for x in chunk_splits(
                    _shaped(v, asked, int(first[ends[i + 1]] - first[ends[i]])), asked, first, ends[i], ends[i + 1])]
                if found:
                    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                                                     [f.split()[0] for f in FOUND.split(", ")])

            try:
                # a candidate for each chunk, class and node comes to the driver
                rows = (blocks.mapInArrow(part, "chunk int, v binary").repartition(max(1, min(partitions, len(ends) - 1)), "chunk")
                        .mapInArrow(add, FOUND).collect())
            finally:
                sent.unpersist()
            return sorted((tuple(r) for r in rows), key=lambda r: r[3])

        def leaves(rounds: list, trees: list) -> np.ndarray:
            sent = sc.broadcast((rounds, trees))
            try:
                return tree_sum(blocks, lambda b, i: _Rows(b, i, start, sent.value[0], rate).leaves(sent.value[1]), partitions)
            finally:
                sent.unpersist()

        try:
            return grow(splits, leaves, k, n_rounds, depth)
        finally:
            shared.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b, i) for b in batches for i in range(b.num_rows)]

        def splits(rounds: list, trees: list, asked: list) -> list[tuple]:
            total = _added(_Rows(b, i, start, rounds, rate).histograms(trees, asked, n_cells) for b, i in held)
            return chunk_splits(total, asked, first, 0, len(first) - 1)

        grown = grow(splits, lambda rounds, trees: sum(_Rows(b, i, start, rounds, rate).leaves(trees) for b, i in held),
                     k, n_rounds, depth)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grown)], pa.binary())], ["grown"])

    return pickle.loads(blocks.mapInArrow(run, "grown binary").first().grown)


class _BoostingParams(HasFeaturesCol, HasLabelCol):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", typeConverter=TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature above zero", typeConverter=TypeConverters.toInt)


class MultiClassBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Labels 0, 1, ...; a label without rows keeps a score so low that it is never predicted."""

    @keyword_only
    def __init__(self, maxIter=50, maxDepth=3, stepSize=0.1, maxBins=16, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(maxIter=50, maxDepth=3, stepSize=0.1, maxBins=16, featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MultiClassBoostingModel":
        g = self.getOrDefault
        label, features = g(self.labelCol), g(self.featuresCol)
        counts = {int(r[0]): r[1] for r in collect_bounded(
            dataset.groupBy(F.col(label).cast("int")).agg(F.count("*")), MAX_CLASSES, "classes")}
        if not counts:
            raise ValueError("a fit needs training rows")
        k = max(2, max(counts) + 1)
        start = np.log(np.maximum([counts.get(c, 0) / sum(counts.values()) for c in range(k)], 1e-15))
        packed = pack(dataset, label, features)
        size = packed.agg(F.max("size")).first()[0]
        first, edges = bin_edges(dataset, features, size, g(self.maxBins))
        blocks = binned(packed, first, edges).persist()
        try:
            partitions = blocks.rdd.getNumPartitions()
            rounds, losses = grow_over(blocks, partitions, first, start, g(self.maxIter), g(self.maxDepth), g(self.stepSize))
        finally:
            blocks.unpersist()
        feature = np.repeat(np.arange(size), np.diff(first))
        trees = []
        for r in rounds:
            trees.append([])
            for t in r:
                split = [None if low == LEAF else (int(feature[low]), float(edges[low - 1]) if low > first[feature[low]] else 0.0)
                         for low in t.low]
                trees[-1].append({"split": split, "value": t.value.tolist()})
        model = MultiClassBoostingModel(start.tolist(), trees, g(self.stepSize), losses)
        return self._copyValues(model)


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        i = self.instance
        DefaultParamsWriter.saveMetadata(i, path, self.sparkSession, extraMetadata={
            "model": json.dumps({"start": i.start, "trees": i.trees, "rate": i.rate, "losses": i.losses})})


class _ModelReader(MLReader):
    def load(self, path: str) -> "MultiClassBoostingModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = json.loads(metadata["model"])
        out = MultiClassBoostingModel(m["start"], m["trees"], m["rate"], m["losses"])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class MultiClassBoostingModel(Model, _BoostingParams, MLWritable, MLReadable):
    """Adds ``rawPrediction`` (scores), ``probability`` (soft-max) and ``prediction``;
    ``losses`` is the training log-loss before each round."""

    def __init__(self, start=(), trees=(), rate=0.1, losses=()):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")
        self.start, self.trees, self.rate, self.losses = list(start), list(trees), rate, list(losses)

    def write(self):
        return _ModelWriter(self)

    @classmethod
    def read(cls):
        return _ModelReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        start, trees, rate = self.start, self.trees, self.rate

        def score(vectors: pa.Array) -> pa.Array:
            import pyarrow.compute  # noqa: F401
            return score_vectors(vectors, start, trees, rate)

        raw = F.arrow_udf(score, "array<double>")(F.col(self.getOrDefault(self.featuresCol)))
        out = dataset.withColumn("_raw", raw)
        top = F.array_max("_raw")
        exps = F.transform("_raw", lambda v: F.exp(v - top))
        total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("rawPrediction", array_to_vector("_raw"))
                .withColumn("probability", array_to_vector(F.transform(exps, lambda e: e / total)))
                .withColumn("prediction", SC.argmax("_raw").cast("double")).drop("_raw"))


def score_vectors(vectors: pa.Array, start: list[float], trees: list[list[dict]], rate: float) -> pa.Array:
    """Scores of a batch: only features that trees ask for are laid out."""
    starts, indices, values, _ = vector_parts(vectors)
    n = len(starts) - 1
    used = sorted({s[0] for r in trees for t in r for s in t["split"] if s})
    place = {f: i for i, f in enumerate(used)}
    x = np.zeros((n, len(used) + 1))
    if used and len(indices):
        at = np.searchsorted(used, indices)
        known = (at < len(used)) & (np.array(used + [LEAF])[np.minimum(at, len(used))] == indices)
        x[np.repeat(np.arange(n), np.diff(starts))[known], at[known]] = values[known]
    f = np.tile(start, (n, 1))
    for r in trees:
        for k, tree in enumerate(r):
            node = np.zeros(n, np.int64)
            for i, s in enumerate(tree["split"]):
                if s:
                    node = np.where(node == i, 2 * i + 1 + (x[:, place[s[0]]] > s[1]), node)
            f[:, k] += rate * np.array(tree["value"])[node]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(start)), pa.array(f.ravel()))
