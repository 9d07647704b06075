"""TF-IDF: the relational long form and the vector pipeline agree."""

from pyspark.sql import functions as F

from moodspark.functions import text as T
from moodspark.operators import features
from moodspark.sources import tables


def test_long_form_equals_vector_form(spark, sf_small):
    d = tables.labelled_documents(spark, sf_small)
    toks = d.select("doc_id", T.tokenize("text").alias("tokens"))
    cfg = dict(features.NOTEBOOK_CONFIG)
    model = features.fit_tfidf(toks, "tokens", **cfg)
    cv = [s for s in model.stages if s.__class__.__name__ == "CountVectorizerModel"][0]
    vec = features.vector_to_long(model.transform(toks), "doc_id", "features", cv.vocabulary)
    terms = toks.select("doc_id", features.ngrams("tokens", cfg["ngram_max"]).alias("terms"))
    vocab, _ = features.fit_vocabulary(terms, "terms", cfg["min_df"], cfg["max_df"], cfg["max_features"])
    assert sorted(r["term"] for r in vocab.collect()) == sorted(cv.vocabulary)
    lng = features.tfidf_long(terms, "doc_id", "terms", vocab, sublinear=True)
    a = {(r["doc_id"], r["term"]): r["weight"] for r in vec.collect()}
    b = {(r["doc_id"], r["term"]): r["weight"] for r in lng.collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_ngrams_order_and_short_docs(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc"],), (["aa"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(features.ngrams("t", 3)).collect()]
    assert got[0] == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert got[1] == ["aa"]
    assert got[2] == []


def test_unseen_terms_give_zero_vector(spark):
    train = spark.createDataFrame([(["alpha", "beta"],), (["alpha", "gamma"],)], "tokens array<string>")
    m = features.fit_tfidf(train, "tokens", ngram_max=1, max_features=10)
    out = m.transform(spark.createDataFrame([(["zzz"],)], "tokens array<string>")).first()["features"]
    assert out.numNonzeros() == 0
