"""How fits are dealt out to tasks and threads; none of it changes what is fitted."""

import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from moodspark.operators import linear_svm, sampling
from moodspark.plans import training


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, i % 3, [words[(i % 3) * 4 + int(rnd.integers(6)) % 4] if rnd.random() < .6 else str(rnd.choice(words))
                        for _ in range(8)], "train") for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, label int, tokens array<string>, split string").persist()


def test_folds_are_fitted_side_by_side(corpus, monkeypatch):
    feats = training.fit_features(corpus)
    x = feats.transform(sampling.stratified_folds(corpus, "label", "doc_id", 3)).withColumn("label", F.col("label").cast("double"))
    plain = CrossValidator(estimator=NaiveBayes(smoothing=.1), estimatorParamMaps=[{}], foldCol="fold", numFolds=3,
                           evaluator=training.WeightedF1Evaluator()).fit(x)
    together = threading.Barrier(3, timeout=60)

    class Waiting:
        def fit(self, df):
            together.wait()
            return NaiveBayes(smoothing=.1).fit(df)

    monkeypatch.setattr(training, "classifier", lambda name, n: Waiting())
    mean, std = training.cross_validate("naive_bayes", corpus, 3, feats)
    assert mean == pytest.approx(plain.avgMetrics[0]) and std == pytest.approx(plain.stdMetrics[0])


def test_forest_has_many_tasks(corpus, monkeypatch):
    seen = []

    class Looking:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return NaiveBayes().fit(df)

    monkeypatch.setattr(training, "FOREST_ROWS", 20)
    monkeypatch.setattr(training, "classifier", lambda name, n: Looking())
    training.fit_classifier("forest", training.fit_features(corpus), corpus)
    training.fit_classifier("logreg", PipelineModel(stages=training.fit_features(corpus).stages), corpus)
    assert seen == [5, 1]


def test_rows_are_packed_once_for_all_penalties(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = [(float(i % 3), Vectors.dense([*(rnd.random(5) + np.eye(5)[i % 3]).tolist()])) for i in range(60)]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(6).persist()
    packed, pack = [], linear_svm.pack
    monkeypatch.setattr(linear_svm, "pack", lambda *a: packed.append(pack(*a)) or packed[-1])
    both = linear_svm.SquaredHingeSVC().fit_each(df, [.5, 2.0], 2)
    # packed where the rows are, in one task for the fit
    assert len(packed) == 1 and packed[0].count() > 1 and packed[0].rdd.getNumPartitions() == 1
    for c, m in zip([.5, 2.0], both):
        alone = linear_svm.SquaredHingeSVC(C=c).fit(df)
        assert np.allclose(m.coefficientMatrix.toArray(), alone.coefficientMatrix.toArray(), atol=1e-6)
    assert not np.allclose(both[0].coefficientMatrix.toArray(), both[1].coefficientMatrix.toArray(), atol=1e-3)
