"""MOD4 against a plain restatement, and what it keeps of a row."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from moodspark.operators import forest
from moodspark.operators.boosting import bin_edges
from moodspark.operators.forest import RandomForest, RandomForestModel
from moodspark.plans import training
from moodspark.session import scratch_path


def data(spark, n=150, size=9, classes=3, seed=0, levels=4, parts=3):
    rnd = np.random.default_rng(seed)
    x = np.where(rnd.random((n, size)) < .5, rnd.integers(1, levels + 1, (n, size)) / 2, 0.0)
    y = (x @ rnd.normal(size=(size, classes)) + rnd.normal(size=(n, classes)) * .5).argmax(1)
    rows = [(float(c), 1.0 + float(c), Vectors.sparse(size, [(j, v[j]) for j in np.flatnonzero(v)])) for c, v in zip(y, x)]
    return x, y, spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(parts).persist()


def plain(x, y, times, weights, draws, depth, seed, tree):
    """One tree by recursion: ``predict(row)`` gives the class distribution of its leaf."""
    def impurity(n):
        n = n * weights
        return n.sum() - (n * n).sum() / max(n.sum(), 1e-300)

    def build(rows, place, left):
        n = np.bincount(y[rows], times[rows], len(weights))
        leaf = n * weights / max((n * weights).sum(), 1e-300)
        best = (1e-12, None)
        if left and (n > 0).sum() > 1:
            for f in draws[int(forest.draw_of(np.array([tree]), np.array([place]), seed)[0])]:
                for t in np.unique(np.append(x[rows, f], 0.0))[:-1]:
                    up = rows[x[rows, f] > t]
                    a = np.bincount(y[up], times[up], len(weights))
                    if 0 < a.sum() < n.sum():
                        gain = (impurity(n) - impurity(a) - impurity(n - a)) / (n * weights).sum()
                        if gain > best[0] + 1e-13:
                            best = (gain, (f, t))
        if best[1] is None:
            return lambda r: leaf
        f, t = best[1]
        low, high = (build(rows[(x[rows, f] > t) == up], 2 * place + up, left - 1) for up in (0, 1))
        return lambda r: high(r) if r[f] > t else low(r)

    return build(np.flatnonzero(times), 1, depth)


def test_trees_equal_a_plain_restatement(spark, monkeypatch):
    trees, depth, seed = 6, 4, 3
    monkeypatch.setattr(forest, "CHUNK_BYTES", 9 * 20)  # here rows are laid out 20 at a time
    _, _, df = data(spark)
    first, edges = bin_edges(df, "features", 9, 31)
    model = RandomForest(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(df)
    # the rows and their draws, in the blocks' order
    x, y, times = [], [], []
    for r in forest.packed(df, "label", "features", first, edges).collect():
        labels, starts, features, bins = (np.frombuffer(v, t) for v, t in zip(r[1:], (np.int16, np.int64, np.int32, np.uint8)))
        x += [out.astype(float) for _, out in forest.laid_out(starts, features, bins, 9)]
        times.append(forest.draws_of_rows(r.id, len(labels), trees, seed).astype(int))
        y.append(labels)
    x, y, times = np.concatenate(x), np.concatenate(y).astype(int), np.concatenate(times)
    draws = forest.feature_draws(9, seed)
    grown = [plain(x, y, times[:, t], np.array([1.0, 2.0, 3.0]), draws, depth, seed, t) for t in range(trees)]
    scored = model.transform(df).select("features", "rawPrediction", "probability", "prediction").collect()
    for r in scored:
        v = r.features.toArray()
        row = np.array([np.searchsorted(edges[first[f]:first[f + 1]], v[f]) + 1 if v[f] else 0 for f in range(9)])
        want = sum(g(row) for g in grown)
        assert np.allclose(r.rawPrediction.toArray(), want) and np.allclose(r.probability.toArray(), want / want.sum())
        assert r.prediction == r.rawPrediction.toArray().argmax()


def test_learns_saves_and_refuses(spark):
    x, y, df = data(spark, n=300)
    model = RandomForest(numTrees=30, maxDepth=6, seed=1).fit(df)
    scored = model.transform(df)
    assert scored.where("prediction = label").count() > 230
    path = scratch_path(spark, "forest")
    model.write().save(path)
    again = RandomForestModel.load(path).transform(df)
    assert again.select("rawPrediction").collect() == scored.select("rawPrediction").collect()
    with pytest.raises(ValueError):
        RandomForest().fit(df.limit(0))
    with pytest.raises(ValueError):
        RandomForest(weightCol="weight").fit(df.withColumn("weight", F.rand(1)))
    one = df.where("label = 1")
    assert {r.prediction for r in RandomForest(maxDepth=1).fit(one).transform(one).collect()} == {1.0}


def test_wide_rows_stay_sparse(spark):
    """A row of a wide vocabulary takes the room of its non-zeros, and its counts that of the cells that occur."""
    size = 50_000
    rows = [(float(i % 2), 1.0, Vectors.sparse(size, sorted((j * 97 + i % 2 * 13) % size for j in range(20)), [.2] * 20)) for i in range(200)]
    df = spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(4).persist()
    held = []
    pack = forest.packed
    try:
        forest.packed = lambda *a: held.append(pack(*a)) or held[-1]
        forest_of_20 = training.classifier("forest", 200)
        model = forest_of_20.copy({forest_of_20.numTrees: 20}).fit(df)
    finally:
        forest.packed = pack
    size_of = sum(sum(len(v) for v in r[1:]) for r in held[0].collect())
    assert size_of < 200 * (20 * 5 + 8 + 2 + 16)
    assert model.transform(df).where("prediction <> label").count() == 0


def test_logistic_regression_has_many_tasks(spark, monkeypatch):
    rows = [(i, i % 3, [f"w{i % 3}", f"w{i % 7}"], "train") for i in range(90)]
    train = spark.createDataFrame(rows, "doc_id long, label int, tokens array<string>, split string").persist()
    seen = []

    class Looking:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return NaiveBayes().fit(df)

    monkeypatch.setattr(training, "LOGREG_ROWS", 20)
    monkeypatch.setattr(training, "classifier", lambda name, n: Looking())
    training.fit_classifier("logreg", training.fit_features(train), train)
    assert seen == [5]
