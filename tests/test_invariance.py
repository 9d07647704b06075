"""SURVEY §5 mutation check: results do not depend on the number of shuffle
partitions (sampling, ensembles/routing, features, dedupe, caps)."""

import pytest

import __spark_entry__ as E

NAMES = ["stratified_split", "stratified_folds", "stratified_cap", "weighted_ensemble", "confidence_route",
         "tfidf_sublinear", "dedupe_text", "cap_rows_per_source", "lexicon_score", "word_top120"]


def _rows(spark, sf, name):
    df = E.queries()[name](spark, sf)
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_invariance(spark, sf_small, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(spark, sf_small, name)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = _rows(spark, sf_small, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == many
