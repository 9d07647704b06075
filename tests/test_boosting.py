"""MOD5 against a plain restatement on whole values."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from moodspark.operators.boosting import MultiClassBoosting, MultiClassBoostingModel
from moodspark.session import scratch_path


def data(spark, n=240, size=6, classes=3, seed=0, levels=4, parts=4):
    rnd = np.random.default_rng(seed)
    x = np.where(rnd.random((n, size)) < .6, rnd.integers(1, levels + 1, (n, size)) / 2, 0.0)
    y = (x @ rnd.normal(size=(size, classes)) + rnd.normal(size=(n, classes)) * .5).argmax(1)
    rows = [(float(c), Vectors.sparse(size, [(j, v[j]) for j in np.flatnonzero(v)])) for c, v in zip(y, x)]
    return x, y, spark.createDataFrame(rows, ["label", "features"]).repartition(parts)


def brute(x, y, k, rounds, depth, rate):
    """Scores after each round: best squared-error split over every threshold, first of equals."""
    f = np.tile(np.log(np.maximum(np.bincount(y, minlength=k) / len(y), 1e-15)), (len(y), 1))
    out = []
    for _ in range(rounds):
        p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
        step = np.zeros_like(f)
        for c in range(k):
            r = (y == c) - p[:, c]

            def split(rows, left):
                best = (1e-12, None)
                if left:
                    for j in range(x.shape[1]):
                        for t in np.unique(np.append(x[:, j], 0.0))[:-1]:
                            up = x[rows, j] > t
                            a, b = r[rows][up], r[rows][~up]
                            if len(a) and len(b):
                                gain = len(a) * len(b) / len(rows) * (a.mean() - b.mean()) ** 2
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, (j, t))
                if best[1] is None:
                    h = (p[rows, c] * (1 - p[rows, c])).sum()
                    step[rows, c] = (k - 1) / k * r[rows].sum() / h if h > 1e-150 else 0
                else:
                    up = x[rows, best[1][0]] > best[1][1]
                    split(rows[~up], left - 1)
                    split(rows[up], left - 1)

            split(np.arange(len(y)), depth)
        f = f + rate * step
        out.append(f)
    return out


@pytest.mark.parametrize("classes, depth", [(3, 3), (4, 2), (2, 1)])
def test_equals_a_plain_restatement_and_loss_falls(spark, classes, depth):
    x, y, df = data(spark, classes=classes, seed=classes)
    model = MultiClassBoosting(maxIter=4, maxDepth=depth, stepSize=.3).fit(df)
    want = brute(x, y, classes, 4, depth, .3)[-1]
    given = {tuple(r.features.toArray()): (r.rawPrediction.toArray(), r.prediction, r.probability.toArray())
             for r in model.transform(df).collect()}
    for row, f in zip(x, want):
        raw, prediction, probability = given[tuple(row)]
        assert np.allclose(raw, f, atol=1e-9) and prediction == raw.argmax()
        assert np.allclose(probability, np.exp(f) / np.exp(f).sum())
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))


def test_partitions_do_not_matter_and_a_saved_model_scores_alike(spark):
    x, y, df = data(spark, n=400, seed=9)
    a, b = (MultiClassBoosting(maxIter=3).fit(df.repartition(p)) for p in (1, 20))
    assert np.allclose(a.losses, b.losses)
    path = scratch_path(spark, "boosting")
    a.write().save(path)
    back = MultiClassBoostingModel.load(path)
    assert [r.rawPrediction for r in back.transform(df).collect()] == [r.rawPrediction for r in a.transform(df).collect()]


def test_wide_vectors_many_values_and_degenerate_inputs(spark):
    rnd = np.random.default_rng(4)
    rows = [(float(i % 3), Vectors.sparse(5000, {(i % 3) * 7: float(rnd.random()) + .1, 100 + int(rnd.integers(4000)): 1.0}))
            for i in range(300)]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(3)
    model = MultiClassBoosting(maxIter=3, maxBins=4).fit(df)
    assert model.transform(df).where("label <> prediction").count() == 0
    with pytest.raises(ValueError):
        MultiClassBoosting().fit(df.limit(0))
    one = df.where("label = 1")
    assert {r.prediction for r in MultiClassBoosting(maxIter=2).fit(one).transform(one).collect()} == {1.0}
    empty = spark.createDataFrame([(0.0, Vectors.sparse(3, {})), (1.0, Vectors.sparse(3, {}))], ["label", "features"])
    assert MultiClassBoosting(maxIter=2).fit(empty).transform(empty).count() == 2
