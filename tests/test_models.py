"""Property tests for model jobs: row counts, class domain, determinism,
save/load equality, stream output = batch output, ensemble/router rules."""

import pytest
from pyspark.sql import functions as F

from moodspark.operators import ensemble, evaluate
from moodspark.plans import scoring, training
from moodspark.session import scratch_path
from moodspark.sources import tables


@pytest.fixture(scope="module")
def corpus(spark, sf_small):
    return training.prepare_corpus(tables.labelled_documents(spark, sf_small)).cache()


@pytest.fixture(scope="module")
def fitted(corpus):
    train = corpus.where(F.col("split") == "train")
    feats = training.fit_features(train)
    return {n: training.fit_classifier(n, feats, train)[0] for n in ("logreg", "naive_bayes", "svm")}


def test_predictions_cover_held_out_rows(corpus, fitted):
    held = corpus.where(F.col("split") != "train")
    n = held.count()
    for name, model in fitted.items():
        p = training.predict(model, held)
        rows = p.collect()
        assert len(rows) == n, name
        assert {r["prediction"] for r in rows} <= {0, 1, 2}


def test_logreg_probabilities_sum_to_one(corpus, fitted):
    from pyspark.ml.functions import vector_to_array
    out = fitted["logreg"].transform(corpus).select(
        F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in out.collect())


def test_deterministic_refit(corpus, fitted):
    train = corpus.where(F.col("split") == "train")
    again, _ = training.fit_classifier("naive_bayes", training.fit_features(train), train)
    a = training.predict(fitted["naive_bayes"], corpus).orderBy("doc_id").collect()
    b = training.predict(again, corpus).orderBy("doc_id").collect()
    assert a == b


def test_save_load_same_predictions(spark, corpus, fitted):
    path = training.save_model(fitted["logreg"], scratch_path(spark, "test-model"))
    loaded = training.load_model(path)
    a = training.predict(fitted["logreg"], corpus).orderBy("doc_id").collect()
    b = training.predict(loaded, corpus).orderBy("doc_id").collect()
    assert a == b


def test_score_rules(spark, sf_small, fitted):
    req = spark.createDataFrame([(0, "RT @x !!! 123"), (1, "great great election vote today"), (2, "")],
                                "ordinal int, text string")
    out = scoring.score_batch(fitted["svm"], req).collect()
    assert [r["ordinal"] for r in out] == [0, 1, 2]
    assert out[0]["label"] == "neutral" and out[0]["score"] == 0.0 and out[0]["tokens"] == ""
    assert out[1]["label"] in ("negative", "neutral", "positive") and 0.0 < out[1]["score"] <= 1.0


def test_stream_equals_batch(spark, sf_small, fitted):
    from moodspark.streaming.scoring import score_stream
    schema = tables.read_table(spark, sf_small, "conversations").schema
    q, sink = score_stream(spark, fitted["logreg"], sf_small, schema, "text", ["conv_id", "turn"],
                           glob="conversations.parquet")
    q.awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).drop("batch_id").collect())
    batch = scoring.score(fitted["logreg"], tables.conversation_turns(spark, sf_small), "text",
                          keep=["conv_id", "turn"])
    assert streamed == sorted(tuple(r) for r in batch.collect())


def test_ensemble_and_router_estimators(corpus):
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from moodspark.operators import features
    train = corpus.where(F.col("split") == "train")
    feats = features.fit_tfidf(train, "tokens", **features.CLI_CONFIG)
    x = feats.transform(train).withColumn("label", F.col("label").cast("double"))
    lr = LogisticRegression(maxIter=50)
    nb = NaiveBayes(smoothing=0.1)
    ens = ensemble.WeightedEnsemble(estimators=[lr, nb], weights=[0.65, 0.35]).fit(x).transform(x)
    assert ens.where(F.col("prediction").isNull()).count() == 0
    rt = ensemble.ConfidenceRouter(primary=lr, fallback=nb, threshold=0.35).fit(x).transform(x)
    r = ensemble.fallback_rate(rt).first()
    assert 0.0 <= r["fallback_rate"] <= 1.0 and r["n"] == x.count()
    mism = rt.where(F.col("use_fallback") != (F.col("margin") < 0.35)).count()
    assert mism == 0


def test_class_report_degenerate(spark):
    # a class never predicted, a class absent from labels
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    rep = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert set(rep) == {0, 1}
    assert rep[0]["precision"] == 1.0 and rep[0]["recall"] == 0.5
    s = evaluate.summary(spark.createDataFrame([(0, 2)], "label int, prediction int")).first()
    assert s["f1_macro"] == 0.0 and s["accuracy"] == 0.0


def test_stream_restart_is_idempotent(spark, sf_small, fitted):
    from moodspark.streaming.scoring import score_stream
    schema = tables.read_table(spark, sf_small, "conversations").schema
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    for _ in range(2):  # second start resumes from the checkpoint: nothing new to write
        q, _ = score_stream(spark, fitted["logreg"], sf_small, schema, "text", ["conv_id", "turn"],
                            sink_dir=sink, checkpoint_dir=ckpt, glob="conversations.parquet")
        q.awaitTermination()
    n = tables.read_table(spark, sf_small, "conversations").count()
    assert spark.read.parquet(sink).count() == n


def test_ensemble_and_router_save_and_load(spark, corpus):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
    from moodspark.operators import features
    train = corpus.where(F.col("split") == "train")
    feats = features.fit_tfidf(train, "tokens", **features.CLI_CONFIG)
    x = feats.transform(train).withColumn("label", F.col("label").cast("double"))
    svc, lr, nb = OneVsRest(classifier=LinearSVC(maxIter=5)), LogisticRegression(maxIter=10), NaiveBayes()
    for est in (ensemble.WeightedEnsemble(estimators=[svc, lr, nb], weights=[0.5, 0.3, 0.2]),
                ensemble.ConfidenceRouter(primary=svc, fallback=lr, threshold=0.2)):
        model = PipelineModel(stages=[*feats.stages, est.fit(x)])
        loaded = training.load_model(training.save_model(model, scratch_path(spark, "test-ensemble")))
        a, b = (m.transform(corpus).select("doc_id", "prediction", "scores").orderBy("doc_id").collect() for m in (model, loaded))
        assert a == b


def test_variants_export_the_best(spark, corpus):
    runs, best = scratch_path(spark, "t-runs"), scratch_path(spark, "t-best")
    rows = training.variant_compare(corpus, skip_tuning=True, runs_path=runs, export_path=best).collect()
    assert len(rows) == 3
    logged = spark.read.schema(training.RUN_SCHEMA).parquet(runs).collect()
    assert {r["run"] for r in logged} == {r["variant"] for r in rows} and all(len(r["report"]) >= 5 for r in logged)
    assert all(training.load_model(r["model_path"]).stages for r in logged)
    model = training.load_model(best)
    top = max(rows, key=lambda r: (r["f1_test"], -r["run_order"]))
    f1 = evaluate.summary(training.predict(model, corpus.where(F.col("split") == "test"))).first()["f1_macro"]
    assert abs(f1 - top["f1_test"]) < 1e-12


def test_cap_bounds_the_fit_rows_only(spark, sf_small):
    d = tables.labelled_documents(spark, sf_small)
    n = {s: r for s, r in training.prepare_corpus(d).groupBy("split").count().collect()}
    capped = {s: r for s, r in training.prepare_corpus(d, sample_per_class=5).groupBy("split").count().collect()}
    assert capped["val"] == n["val"] and capped["test"] == n["test"] and capped["train"] <= 15 < n["train"]
    first = training.prepare_corpus(d, sample_per_class=5, sample_first=True)
    assert first.count() <= 15


def test_train_on_a_user_s_csv(spark):
    from moodspark.sources.columns import load_labelled
    from moodspark.sources.files import read_csv, write_csv
    rows = [(i, f"{'happy sunny great' if i % 3 == 2 else 'gloomy awful rain' if i % 3 == 0 else 'table chair window'} words number {i}",
             ["negative", "neutre", "positif"][i % 3]) for i in range(90)]
    path = write_csv(spark.createDataFrame(rows, "id int, content string, target string"), scratch_path(spark, "user-csv"))
    loaded = load_labelled(read_csv(spark, path, "id int, content string, target string"), keep=["id"])
    corpus = training.prepare_corpus(loaded, id_col="id", tokenised=True)
    p = training.train_and_predict(corpus, "logreg").collect()
    assert len(p) == corpus.where("split <> 'train'").count() and sum(r["label"] == r["prediction"] for r in p) / len(p) > 0.9


def test_registry_versions_and_errors(spark, tmp_path):
    reg = scratch_path(spark, "t-reg")
    assert [training.register(spark, reg, "m", "p", {"f1": 0.5}, {"a": 1}) for _ in range(3)] == [1, 2, 3]
    assert training.register(spark, reg, "other", "p", {}) == 1
    bad = tmp_path / "reg"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        training.register(spark, str(bad), "m", "p", {})


def test_fold_scores_equal_refits(spark):
    """The model without a fold, by subtraction, is the model fitted without it."""
    from moodspark.plans import naive_bayes as NB
    w = spark.createDataFrame([(d, d % 2, d % 3, t, float((d * 7 + k) % 5 + 1)) for d in range(12) for k, t in enumerate("abc") if (d + k) % 4],
                              "doc_id long, label int, fold int, term string, weight double")
    docs = w.select("doc_id", "label", "fold").distinct()
    vocab = w.select("term").distinct()
    got = {r["doc_id"]: r["scores"] for r in NB.fold_scores(docs, w, vocab, [0, 1], 0.5).collect()}
    for f in range(3):
        rest = w.where(F.col("fold") != f)
        sums = NB.over_vocabulary(NB.class_sums(rest, [0, 1]), vocab, [0, 1])
        total, v = NB.totals(sums, [0, 1])
        prior = NB.log_priors(docs.where(F.col("fold") != f), [0, 1])
        own = NB.joint_scores(docs.where(F.col("fold") == f), w.where(F.col("fold") == f), sums, prior, total, v, {"s": 0.5})
        for r in own.collect():
            assert max(abs(a - b) for a, b in zip(got[r["doc_id"]], r["s"])) < 1e-9
