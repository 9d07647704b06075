"""MOD3: linear support vector machine with squared hinge loss and penalised intercept.

For each class against the rest the fit minimises::

    |w|^2 / 2 + C * sum(max(0, 1 - y * (w . x + b)) ^ 2)      (b is part of w)

by truncated Newton: conjugate gradients on Hessian products, then a step that is
halved until the loss falls enough.  All classes, and all weights ``C`` of the loss, share
the passes; a pass is one job whose partial sums are added up as a tree, and the driver
holds the weights alone (problems times vocabulary, which the features bound).

The fitted margins live in Spark's own linear multi-class model: its raw prediction
is the decision scores, its prediction their first maximum and its probability their
soft-max, which is the confidence that scoring asks for.  So prediction stays in the
JVM, works on streams, and saves and loads like any model.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, Identifiable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.operators.blocks import Block, joined, pack, tree_sum

#: A fit's classes at most: each has a row of weights in the driver.
MAX_CLASSES = 1000
#: Conjugate gradient steps of one Newton step, and halvings of a step, at most.
MOST_PRODUCTS, MOST_HALVINGS = 100, 30
#: Rows of a task.  Rows of one task are fitted in one job; more take a job for each pass, of which
#: a fit has hundreds.
TASK_ROWS = 20_000


def _sides(labels: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.where(labels[:, None] == classes[None, :], 1.0, -1.0)


class _Passes:
    """Sums over the training rows at given weights, for the problems ``which``, each
    with a class and a ``C``; ``total(shared, work)`` adds up ``work(block, *shared)`` over all blocks."""

    def __init__(self, total, classes: np.ndarray, C: np.ndarray):
        self._sum, self.classes, self.C = total, classes, C

    def loss_and_gradient(self, w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(block: Block, w: np.ndarray, classes: np.ndarray) -> np.ndarray:
            y = _sides(block.labels, classes)
            m = block.dot(w)
            short = np.maximum(0.0, 1.0 - y * m)
            return np.concatenate([(short ** 2).sum(0), block.transposed_dot(np.where(short > 0, m - y, 0.0)).ravel()])

        s = self._sum((w[which], self.classes[which]), work)
        k, c = len(which), self.C[which]
        return c * s[:k] + .5 * (w[which] ** 2).sum(1), 2 * c[:, None] * s[k:].reshape(k, -1) + w[which]

    def hessian_product(self, w: np.ndarray, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        def work(block: Block, w: np.ndarray, v: np.ndarray, classes: np.ndarray) -> np.ndarray:
            m, p = np.hsplit(block.dot(np.concatenate([w, v])), 2)
            return block.transposed_dot(np.where(_sides(block.labels, classes) * m < 1, p, 0.0)).ravel()

        s = self._sum((w[which], v, self.classes[which]), work)
        return 2 * self.C[which, None] * s.reshape(len(which), -1) + v

    def losses_along(self, w: np.ndarray, d: np.ndarray, steps: np.ndarray, which: np.ndarray) -> np.ndarray:
        def work(block: Block, w: np.ndarray, d: np.ndarray, steps: np.ndarray, classes: np.ndarray) -> np.ndarray:
            y, (m, p) = _sides(block.labels, classes), np.hsplit(block.dot(np.concatenate([w, d])), 2)
            return np.concatenate([(np.maximum(0.0, 1.0 - y * (m + t * p)) ** 2).sum(0) for t in steps])

        s = self.C[which] * self._sum((w[which], d, steps, self.classes[which]), work).reshape(len(steps), -1)
        moved = w[which][None] + steps[:, None, None] * d[None]
        return s + .5 * (moved ** 2).sum(2)


def solve_over(blocks: DataFrame, partitions: int, size: int, classes: np.ndarray, C: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """``solve`` with a job for each pass; blocks of one partition are one task's in any
    case, so there all passes are one job."""
    sc = blocks.sparkSession.sparkContext
    if partitions > 1:
        def total(shared: tuple, work) -> np.ndarray:
            sent = sc.broadcast(shared)
            try:
                return tree_sum(blocks, lambda batch, i: work(Block.of(batch, i), *sent.value), partitions)
            finally:
                sent.unpersist()

        return solve(total, size, classes, C, tol, max_iter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Block.joined([Block.of(b, i) for b in batches for i in range(b.num_rows)])
        w = solve(lambda shared, work: work(rows, *shared), size, classes, C, tol, max_iter)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    return np.frombuffer(blocks.mapInArrow(run, "w binary").first().w).reshape(len(classes), size + 1)


def solve(total, size: int, classes: np.ndarray, C: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """Weights, a row for each problem (a class and a ``C``) and the intercept last."""
    passes = _Passes(total, classes, C)
    k = len(classes)
    w, every = np.zeros((k, size + 1)), np.arange(k)
    loss, grad = passes.loss_and_gradient(w, every)
    start = np.linalg.norm(grad, axis=1)
    for _ in range(max_iter):
        norm = np.linalg.norm(grad, axis=1)
        open_ = np.flatnonzero(norm > tol * np.maximum(start, 1e-300))
        if not len(open_):
            break
        d, r = np.zeros((k, size + 1)), -grad
        s, rr = r.copy(), (r * r).sum(1)
        enough = np.minimum(.1, np.sqrt(norm / np.maximum(start, 1e-300))) * norm
        busy = open_
        for _ in range(MOST_PRODUCTS):
            hs = passes.hessian_product(w, s[busy], busy)
            alpha = rr[busy] / (s[busy] * hs).sum(1)
            d[busy] += alpha[:, None] * s[busy]
            r[busy] -= alpha[:, None] * hs
            new = (r[busy] ** 2).sum(1)
            s[busy] = r[busy] + (new / rr[busy])[:, None] * s[busy]
            rr[busy] = new
            busy = busy[np.sqrt(new) > enough[busy]]
            if not len(busy):
                break
        slope = (grad * d).sum(1)
        trial = w.copy()
        trial[open_] += d[open_]
        new_loss, new_grad = passes.loss_and_gradient(trial, open_)
        bad = open_[new_loss > loss[open_] + 1e-4 * slope[open_] + 1e-12 * np.abs(loss[open_])]
        if len(bad):
            steps = .5 ** np.arange(1, MOST_HALVINGS + 1)
            fine = passes.losses_along(w, d[bad], steps, bad) <= loss[bad] + 1e-4 * steps[:, None] * slope[bad]
            step = np.where(fine.any(0), steps[fine.argmax(0)], 0.0)
            trial[bad] = w[bad] + step[:, None] * d[bad]
            new_loss, new_grad = passes.loss_and_gradient(trial, open_)
            stuck = bad[step == 0]
            start[stuck] = np.inf  # no step lowers the loss: as exact as doubles allow
        w, loss[open_], grad[open_] = trial, new_loss, new_grad
    return w


class SquaredHingeSVC(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """One-vs-rest over labels 0, 1, ...; two labels are one problem with scores -v and v."""

    C = Param(Params._dummy(), "C", "weight of the loss against the penalty", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "Newton steps at most", typeConverter=TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "gradient norm at the end, relative to the first", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, C=1.0, maxIter=2000, tol=1e-4, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(C=1.0, maxIter=2000, tol=1e-4, featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        return self.fit_each(dataset, [self.getOrDefault(self.C)])[0]

    def fit_each(self, dataset: DataFrame, Cs: list[float], parallelism: int = 1) -> list[LogisticRegressionModel]:
        """A model for each weight of the loss; the rows are packed once for all."""
        label, features = self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol)
        blocks = pack(dataset, label, features, TASK_ROWS).persist()
        try:
            about = blocks.agg(F.max("size").alias("size"), F.count("*").alias("n")).first()
            if not about["n"]:
                raise ValueError("a fit needs training rows")
            highest = dataset.agg(F.max(F.col(label).cast("int"))).first()[0]
            if highest >= MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes")
            n = max(2, highest + 1)
            classes = np.arange(1.0, 2.0) if n == 2 else np.arange(float(n))
            partitions = blocks.rdd.getNumPartitions()
            stop = self.getOrDefault(self.tol), self.getOrDefault(self.maxIter)
            if partitions > 1:  # a pass is a job, for all weights of the loss at once
                wide = joined(blocks).persist()
                try:
                    w = solve_over(wide, partitions, about["size"], np.tile(classes, len(Cs)), np.repeat(Cs, len(classes)), *stop)
                finally:
                    wide.unpersist()
                found = list(w.reshape(len(Cs), len(classes), -1))
            else:  # a fit is a job
                with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                    found = list(pool.map(lambda c: solve_over(
                        blocks, 1, about["size"], classes, np.repeat(c, len(classes)), *stop), Cs))
        finally:
            blocks.unpersist()
        return [linear_model(np.concatenate([-w, w]) if n == 2 else w, features) for w in found]


def linear_model(w: np.ndarray, features_col: str = "features") -> LogisticRegressionModel:
    """Spark's multi-class linear model with the given margins (intercept last)."""
    n, size = len(w), w.shape[1] - 1
    model = LogisticRegressionModel._create_from_java_class(
        "org.apache.spark.ml.classification.LogisticRegressionModel", Identifiable().uid,
        DenseMatrix(n, size, w[:, :-1].ravel(), isTransposed=True), DenseVector(w[:, -1]), n, True)
    return model.setFeaturesCol(features_col)
