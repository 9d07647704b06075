"""Registered fits take all rows of the train part, however many a class has."""

import pytest
from pyspark.ml.classification import NaiveBayes

from moodspark.operators import sampling
from moodspark.plans import catalog, training
from moodspark.sources import tables


@pytest.mark.parametrize("query", ["train_logreg", "train_svm"])
def test_fits_take_the_whole_train_part(spark, sf_small, monkeypatch, query):
    fitted = []

    class Counting:
        def fit(self, df):
            fitted.append(df.count())
            return NaiveBayes().fit(df)

    # a bound that rows do reach, as 200,000 a class would on larger tables
    bound = tuple(5 if d == training.SAMPLE_PER_CLASS else d for d in training.prepare_corpus.__defaults__)
    monkeypatch.setattr(training.prepare_corpus, "__defaults__", bound)
    monkeypatch.setattr(training, "classifier", lambda name, n, C=None: Counting())
    held = catalog.QUERIES[query](spark, sf_small).count()
    whole = training.prepare_corpus(tables.labelled_documents(spark, sf_small), sample_per_class=None)
    n = dict(sampling.stratified_split(whole.drop("split"), "label", "doc_id").groupBy("split").count().collect())
    assert fitted == [n["train"]] and held == n["val"] + n["test"]
