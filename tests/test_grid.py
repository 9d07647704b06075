"""The grid search shares what does not depend on a fold or a penalty; none of it changes what is fitted."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from moodspark.operators import features, linear_svm, sampling
from moodspark.plans import training


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, i % 3, [str(w) for w in rnd.choice(words, 6, p=np.arange(1, 31) / 465)] + [words[i % 3]] * 3) for i in range(60)]
    df = spark.createDataFrame(docs + [(60, 0, [])], "doc_id long, label int, tokens array<string>")
    return sampling.stratified_folds(df, "label", "doc_id", 3).persist()


@pytest.mark.parametrize("config", [dict(max_features=25), dict(max_features=10_000, min_df=.05, max_df=.5)])
def test_vocabularies_of_folds_equal_own_fits(rows, config):
    fitted = features.fit_tfidf_folds(rows, "tokens", "fold", 3, [2, 3], **config)
    assert set(fitted) == {(n, f) for n in (2, 3) for f in (0, 1, 2, None)}
    for n, f in [(2, 0), (3, None)]:
        own = features.fit_tfidf(rows.where(F.col("fold") != f) if f is not None else rows, "tokens", ngram_max=n, **config)
        got = fitted[n, f].stages
        assert len(got[1].vocabulary) > 20 and got[1].vocabulary == own.stages[1].vocabulary
        assert np.allclose(got[2].getScalingVec().toArray(), own.stages[2].getScalingVec().toArray())


def test_terms_are_counted_once_for_the_grid(rows, monkeypatch):
    counts = []
    count = features.term_stats
    monkeypatch.setattr(features, "term_stats", lambda *a, **b: counts.append(1) or count(*a, **b))
    _, params = training.grid_search(rows.drop("fold"), 3, [.5, 2.0], [2], 2)
    assert not counts and params["cv_f1_macro"] > .5


def test_penalties_share_the_passes(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    df = spark.createDataFrame([(float(i % 3), Vectors.dense([*(rnd.random(5) + np.eye(5)[i % 3]).tolist()])) for i in range(60)],
                               ["label", "features"]).repartition(3).persist()
    alone = [linear_svm.SquaredHingeSVC(C=c).fit(df) for c in (.5, 2.0)]
    monkeypatch.setattr(linear_svm, "TASK_ROWS", 20)  # many tasks, a job for each pass
    fits, solve = [], linear_svm.solve_over
    monkeypatch.setattr(linear_svm, "solve_over", lambda *a: fits.append(a) or solve(*a))
    both = linear_svm.SquaredHingeSVC().fit_each(df, [.5, 2.0], 2)
    assert len(fits) == 1
    for m, a in zip(both, alone):
        assert np.allclose(m.coefficientMatrix.toArray(), a.coefficientMatrix.toArray(), atol=1e-6)
