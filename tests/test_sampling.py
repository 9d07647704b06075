"""Hash-rank sampling: bucketed rank equals the global window; results do not
depend on the number of shuffle partitions; exact class proportions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodspark.operators import sampling
from moodspark.sources import tables


def _labelled(spark, sf):
    return tables.labelled_documents(spark, sf).select("doc_id", "label")


def test_bucket_rank_equals_window(spark, sf_small):
    d = _labelled(spark, sf_small)
    got = {(r["doc_id"]): r["rank"] for r in sampling.class_rank(d, "label", "doc_id").collect()}
    w = Window.partitionBy("label").orderBy(sampling.hash_key("doc_id"), "doc_id")
    ref = {r["doc_id"]: r["r"] for r in d.select("doc_id", F.row_number().over(w).alias("r")).collect()}
    assert got == ref


def test_rank_with_one_bucket_digit_equals_window(spark, sf_small):
    d = _labelled(spark, sf_small)
    a = {r["doc_id"]: r["rank"] for r in sampling.class_rank(d, "label", "doc_id", bucket_digits=1).collect()}
    b = {r["doc_id"]: r["rank"] for r in sampling.class_rank(d, "label", "doc_id", bucket_digits=4).collect()}
    assert a == b


def test_split_proportions_and_partition_invariance(spark, sf_small):
    d = _labelled(spark, sf_small)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted((r["doc_id"], r["label"], r["split"])
                     for r in sampling.stratified_split(d, "label", "doc_id").collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted((r["doc_id"], r["label"], r["split"])
                       for r in sampling.stratified_split(d, "label", "doc_id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
    counts = {}
    for doc_id, label, split in one:
        counts.setdefault(label, {}).setdefault(split, 0)
        counts[label][split] += 1
    for label, c in counts.items():
        n = sum(c.values())
        assert c.get("train", 0) == (7 * n) // 10
        assert c.get("train", 0) + c.get("val", 0) == (17 * n) // 20


def test_cap_and_folds(spark, sf_small):
    d = _labelled(spark, sf_small)
    capped = sampling.stratified_cap(d, "label", "doc_id", 5)
    per = {r["label"]: r["n"] for r in capped.groupBy("label").agg(F.count("*").alias("n")).collect()}
    full = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert per == {k: min(v, 5) for k, v in full.items()}
    assert sampling.stratified_cap(d, "label", "doc_id", 0) is d
    folds = sampling.stratified_folds(d, "label", "doc_id", 3)
    sizes = folds.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["label"], []).append(r["count"])
    for v in by_label.values():
        assert max(v) - min(v) <= 1


def test_cap_then_split_equals_split_of_capped(spark, sf_small):
    d = _labelled(spark, sf_small)
    fused = sorted((r["doc_id"], r["split"]) for r in sampling.stratified_split(d, "label", "doc_id", cap=9, sample_first=True).collect())
    capped = sampling.stratified_cap(d, "label", "doc_id", 9)
    twostep = sorted((r["doc_id"], r["split"]) for r in sampling.stratified_split(capped, "label", "doc_id").collect())
    assert fused == twostep
