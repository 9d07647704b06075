"""MOD3 against a dense solve: same objective, same coefficients."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from moodspark.operators import linear_svm
from moodspark.operators.blocks import Block, pack, tree_sum
from moodspark.operators.linear_svm import SquaredHingeSVC


def data(spark, n=300, size=12, classes=3, seed=0, parts=5, dense=False):
    rnd = np.random.default_rng(seed)
    x = np.where(rnd.random((n, size)) < .4, rnd.random((n, size)), 0.0)
    y = (x @ rnd.normal(size=(size, classes)) + rnd.normal(size=(n, classes)) * .4).argmax(1)
    rows = [(float(c), Vectors.dense(v) if dense and i % 2 else Vectors.sparse(size, [(j, v[j]) for j in np.flatnonzero(v)]))
            for i, (c, v) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, ["label", "features"]).repartition(parts)


def dense_solve(x, y, C):
    """Newton with the whole Hessian."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    f = lambda w: .5 * w @ w + C * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(200):
        m = x @ w
        i = y * m < 1
        g = w + 2 * C * x[i].T @ (m[i] - y[i])
        if np.linalg.norm(g) < 1e-11:
            break
        d = -np.linalg.solve(np.eye(len(w)) + 2 * C * x[i].T @ x[i], g)
        t = 1.0
        while f(w + t * d) > f(w) + 1e-4 * t * g @ d and t > 1e-9:
            t /= 2
        w = w + t * d
    return w


@pytest.mark.parametrize("C, classes, dense", [(1.0, 3, False), (50.0, 3, True), (.01, 4, False), (1.0, 2, False)])
def test_coefficients_equal_a_dense_solve(spark, C, classes, dense):
    x, y, df = data(spark, classes=classes, dense=dense)
    model = SquaredHingeSVC(C=C, tol=1e-9).fit(df)
    got = np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])
    for k in range(classes):
        want = dense_solve(x, np.where(y == k, 1.0, -1.0), C)
        assert np.abs(got[k] - want).max() < 1e-4
    # scores, first maximum, soft-max
    r = model.transform(df).first()
    score = got[:, :-1] @ r.features.toArray() + got[:, -1]
    assert np.allclose(r.rawPrediction.toArray(), score)
    assert r.prediction == score.argmax()
    assert np.allclose(r.probability.toArray(), np.exp(score - score.max()) / np.exp(score - score.max()).sum())


def test_default_tolerance_is_close_and_partitions_do_not_matter(spark, monkeypatch):
    x, y, df = data(spark, n=500, seed=3)
    a = SquaredHingeSVC().fit(df)
    monkeypatch.setattr(linear_svm, "TASK_ROWS", 20)  # many tasks, a job for each pass
    b = SquaredHingeSVC().fit(df)
    assert np.abs(a.coefficientMatrix.toArray() - b.coefficientMatrix.toArray()).max() < 1e-6
    assert np.abs(a.coefficientMatrix.toArray()[0] - dense_solve(x, np.where(y == 0, 1.0, -1.0), 1.0)[:-1]).max() < 1e-2


def test_degenerate_inputs(spark):
    _, _, df = data(spark, n=20)
    with pytest.raises(ValueError):
        SquaredHingeSVC().fit(df.limit(0))
    one = df.where("label = 0")
    assert {r.prediction for r in SquaredHingeSVC().fit(one).transform(one).collect()} == {0.0}
    gap = df.where("label <> 1")  # class 1 has no rows: never predicted
    assert 1.0 not in {r.prediction for r in SquaredHingeSVC().fit(gap).transform(gap).collect()}


def test_tree_sum_equals_a_plain_sum(spark):
    x, y, df = data(spark, n=400, parts=23)
    total = tree_sum(pack(df), lambda b, i: Block.of(b, i).transposed_dot(np.ones((len(Block.of(b, i).labels), 1))).ravel(), 23, fan=3)
    assert np.allclose(total, np.append(x.sum(0), len(x)))
