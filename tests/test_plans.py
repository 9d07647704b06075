"""Plan-shape regression tests for the scale properties claimed in the README."""

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_chain_evaluated_once_under_explode(spark, sf_small):
    p = _plan(E.queries()["word_top120"](spark, sf_small))
    # the URL pattern is the first step of the chain; it must appear once
    assert p.count("(http|www|https)") == 1


def test_group_cap_has_partial_limits_and_leaves_settings_alone(spark, sf_small):
    from moodspark.sources.files import cap_rows_per_group
    from moodspark.sources import tables
    d = tables.documents(spark, sf_small, "doc_id", "source")
    p = _plan(cap_rows_per_group(d, "source", "doc_id", 100))
    assert p.count("Partial") >= 2 and "WindowGroupLimit" in p
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None)
    cap_rows_per_group(d, "source", "doc_id", 5000)
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None) == before


def test_plans_do_not_depend_on_the_number_of_cores(spark, sf_small):
    """No count, repartition or broadcast of the library's own depends on the cluster."""
    p = _plan(E.queries()["clean_text"](spark, sf_small))
    assert "Exchange" not in p


def test_dedupe_and_funnel_shuffle_digests(spark, sf_small):
    p = _plan(E.queries()["funnel_counts"](spark, sf_small))
    assert "Join" not in p and p.count("Exchange hashpartitioning(_d") == 1
    p = _plan(E.queries()["dedupe_text"](spark, sf_small))
    assert "unhex(sha2(" in p and "hashpartitioning(text" not in p


def test_derived_columns_clean_once(spark, sf_small):
    p = _plan(E.queries()["derived_columns"](spark, sf_small))
    assert p.split("== ")[0].count("(http|www|https)") == 1


def test_no_row_at_a_time_python_in_features(spark, sf_small):
    from moodspark.functions import text as T
    from moodspark.operators import features
    from moodspark.sources import tables
    toks = tables.labelled_documents(spark, sf_small).select("doc_id", T.tokenize("text").alias("tokens"))
    p = _plan(features.fit_tfidf(toks, "tokens", **features.NOTEBOOK_CONFIG).transform(toks))
    assert "ArrowEvalPython" in p and "BatchEvalPython" not in p


def test_tfidf_weights_use_one_document_partitioning(spark, sf_small):
    p = _plan(E.queries()["tfidf_plain"](spark, sf_small))
    # the (doc, term) count and the per-document norm share one exchange by doc
    assert p.count("REPARTITION_BY_COL") == 1


def test_lexicon_scoring_does_not_shuffle_text(spark, sf_small):
    df = E.queries()["lexicon_score"](spark, sf_small)
    p = _plan(df)
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    # only ids and partial sums cross the document-keyed exchange
    assert "hashpartitioning(doc_id" in p


def test_scans_prune_columns(spark, sf_small):
    p = _plan(E.queries()["class_counts"](spark, sf_small))
    assert "ReadSchema: struct<doc_id:bigint>" in p  # documents side reads ids only
