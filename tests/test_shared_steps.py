"""Steps that several queries share: code for tasks, streams of tables, sums of blocks, features."""

import threading
import time
from types import SimpleNamespace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from moodspark import session
from moodspark.session import scratch_path


def test_package_is_shipped_once_by_threads():
    added = []

    class Context:
        master = "spark://far"

        def addPyFile(self, path):
            time.sleep(0.05)
            added.append(path)

    spark = SimpleNamespace(sparkContext=Context())
    ships = [threading.Thread(target=session.ship_package, args=(spark,)) for _ in range(4)]
    for t in ships:
        t.start()
    for t in ships:
        t.join()
    assert len(added) == 1


def test_stream_reads_tables_of_many_files(spark):
    from moodspark.streaming.scoring import score_stream
    rows = spark.createDataFrame([(i, f"great vote {i}") for i in range(20)], "conv_id long, text string")
    root = scratch_path(spark, "t-tables")
    rows.repartition(3).write.parquet(f"{root}/conversations.parquet")
    rows.limit(1).write.parquet(f"{root}/other.parquet")
    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, 2.0D AS prediction FROM __THIS__")])
    q, sink = score_stream(spark, model, root, rows.schema, "text", ["conv_id"], glob="conversations.parquet")
    q.awaitTermination()
    assert sorted(r.conv_id for r in spark.read.parquet(sink).collect()) == list(range(20))


def test_chunks_hold_whole_features():
    from moodspark.operators.boosting import chunk_ends
    first = np.array([0, 3, 3, 9, 10, 14])
    assert chunk_ends(first, 4).tolist() == [0, 2, 3, 4, 5]
    assert chunk_ends(first, 100).tolist() == [0, 5]
    assert chunk_ends(np.array([0])).tolist() == [0]


def test_boosting_sends_no_histograms_to_the_driver(spark, monkeypatch):
    """Over several partitions the driver gets candidates, and chunks don't change the trees."""
    from pyspark.ml.linalg import Vectors

    from moodspark.operators import boosting
    rnd = np.random.default_rng(3)
    rows = [(float(rnd.integers(3)), Vectors.sparse(40, sorted(rnd.choice(40, 8, replace=False).tolist()), (rnd.random(8) + .1).tolist()))
            for _ in range(200)]
    df = spark.createDataFrame(rows, ["label", "features"])
    whole = boosting.MultiClassBoosting(maxIter=3).fit(df.coalesce(1))
    longest = []
    add = boosting.tree_sum
    monkeypatch.setattr(boosting, "tree_sum", lambda *a: longest.append(len(s := add(*a))) or s)
    monkeypatch.setattr(boosting, "chunk_ends", lambda first, size=30, f=boosting.chunk_ends: f(first, size))
    cut = boosting.MultiClassBoosting(maxIter=3).fit(df.repartition(4))
    assert np.allclose(whole.losses, cut.losses) and [t["split"] for r in whole.trees for t in r] == [t["split"] for r in cut.trees for t in r]
    assert max(longest) == 2 + 3 * 2 * 15


def cleanings(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("(http|www|https)")


def test_short_texts_are_cleaned_once(spark, sf_small):
    from moodspark.plans import catalog
    assert cleanings(catalog.QUERIES["short_text_filter"](spark, sf_small)) == 1


def test_token_count_names_its_text_once(spark):
    from pyspark.sql import functions as F

    from moodspark.functions import text
    df = spark.createDataFrame([(None,), ("",), (" \t ",), ("a",), (" a  b c ",)], "t string")
    assert [r[0] for r in df.select(text.token_count(F.concat("t", F.lit("")))).collect()] == [0, 0, 0, 1, 3]
    assert df.select(text.token_count(F.concat("t", F.lit(""))).alias("n"))._jdf.queryExecution().analyzed().toString().count("concat(") == 1


def test_prepared_texts_are_cleaned_once(spark):
    from moodspark.plans.training import prepare_corpus
    df = spark.createDataFrame([(i, f"great vote {i}" if i % 3 else "!!", i % 2) for i in range(30)], "doc_id long, text string, label int")
    rows = prepare_corpus(df, materialize=False)
    # the split's ranking and its histogram read the texts once each
    assert cleanings(rows) == 2 and rows.count() == 20


def test_frequent_terms_are_not_shuffled_by_term(spark):
    from moodspark.operators import features
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, ["the", f"w{i % 4}"]) for i in range(40)], "doc_id long, terms array<string>")
        vocab, _ = features.fit_vocabulary(df, "terms", 1, 1.0, 100)
        plan = features.tfidf_long(df, "doc_id", "terms", vocab, sublinear=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_long_weights_of_few_occurrences_a_task(spark, monkeypatch):
    """Tasks go by the occurrences that the caller states; the weights don't depend on them."""
    from pyspark.sql import functions as F

    from moodspark.operators import features
    rows = [(i if i % 9 else 3, [f"w{(i * j) % 23}" for j in range(1, 20)]) for i in range(60)] + [(None, ["w1", "w2", "w2"])]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    vocab, _ = features.fit_vocabulary(df, "terms", 1, 1.0, 100)
    assert features.occurrences(vocab) == sum(len(t) for _, t in rows)
    monkeypatch.setattr(features, "TASK_OCCURRENCES", 100)
    many = features.tfidf_long(df, "doc_id", "terms", vocab, sublinear=True, occurs=features.occurrences(vocab))
    assert many.rdd.getNumPartitions() == -(-sum(len(t) for _, t in rows) // 100)
    few = features.tfidf_long(df, "doc_id", "terms", vocab, sublinear=True)

    def found(w):
        return sorted((r.doc_id or -1, r.term, round(r.weight, 9)) for r in w.collect())

    assert found(many) == found(few)
    assert few.select(F.count("*")).first()[0] > 100


def test_term_counts_by_one_row_an_occurrence(spark, monkeypatch):
    """Documents with and without repeated, null or no terms; terms in too few documents are not kept for the choice."""
    from moodspark.operators import features
    rows = [(["a", "b", "a"],), (["b", None, None],), ([],), (None,), (["c", "c"],)]
    df = spark.createDataFrame(rows, "terms array<string>")
    found = {r.term: (r.df, r.ctf) for r in features.term_stats(df, "terms", count_docs=True).collect()}
    assert {k: v for k, v in found.items() if k} == {"a": (1, 2), "b": (2, 2), "c": (1, 2)}
    assert found[None][0] == 4  # documents that have an array, each once
    plain = {r.term: (r.df, r.ctf) for r in features.term_stats(df, "terms").where("term is not null").collect()}
    assert plain == {"a": (1, 2), "b": (2, 2), "c": (1, 2)}
    kept = []
    monkeypatch.setattr(features, "reliable_checkpoint", lambda d: kept.extend(d.collect()) or d)
    vocab, n = features.fit_vocabulary(df, "terms", 2, 1.0, 10)
    assert n == 4 and [(r.term, r.df, r.ctf) for r in vocab.collect()] == [("b", 2, 2)]
    assert sorted(str(r.term) for r in kept) == ["None", "b"]


def test_long_weights_shuffle_documents(spark, monkeypatch):
    """Where their number is stated, occurrences are worked out behind the shuffle, from what n-grams are made of."""
    from moodspark.operators import features
    df = spark.createDataFrame([(i % 30, [f"w{(i * j) % 11}" for j in range(6)], "x" * 20) for i in range(40)],
                               "doc_id long, tokens array<string>, text string")
    monkeypatch.setattr(features, "TASK_OCCURRENCES", 100)
    terms = features.ngrams("tokens", 2)
    vocab, _ = features.fit_vocabulary(df.select(terms.alias("terms")), "terms", 1, 1.0, 100)
    weights = features.tfidf_long(df, "doc_id", terms, vocab, sublinear=True, occurs=features.occurrences(vocab))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert plan.index("Generate explode(_terms") < plan.index("zip_with") < plan.index("Exchange hashpartitioning(doc_id")
    other = features.tfidf_long(df.select("doc_id", terms.alias("terms")), "doc_id", "terms", vocab, sublinear=True)

    def found(w):
        return sorted((r.doc_id, r.term, round(r.weight, 9)) for r in w.collect())

    assert found(weights) == found(other)
