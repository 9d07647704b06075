"""Published counts as arithmetic goldens (FIXTURES ``report_counts``): the
label counts of the three reference datasets, expanded to rows in Spark, must
reproduce the published totals and shares through the profile operators."""

from pyspark.sql import functions as F

from moodspark.operators import stats

# Published label counts per dataset.
REPORT_COUNTS = [
    ("DS1", "positive", 95969), ("DS1", "negative", 79817), ("DS1", "neutral", 62636),
    ("DS2", "neutral", 364), ("DS2", "negative", 257), ("DS2", "positive", 146),
    ("DS3", "neutral", 554207), ("DS3", "positive", 485892), ("DS3", "negative", 416545),
]


def _rows(spark):
    counts = spark.createDataFrame(REPORT_COUNTS, "source_dataset string, sentiment_label string, n int")
    return counts.select("source_dataset", "sentiment_label",
                         F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def test_profile_reproduces_published_counts(spark):
    prof = {r["source_dataset"]: r for r in stats.dataset_profile(_rows(spark), "source_dataset",
                                                                  "sentiment_label").collect()}
    assert prof["DS1"]["tweets"] == 238422
    assert prof["DS2"]["tweets"] == 767
    assert prof["DS3"]["tweets"] == 1456644
    assert round(prof["DS1"]["pct_positive"], 2) == 40.25
    share = {r["source_dataset"]: r for r in stats.dataset_share(_rows(spark), "source_dataset").collect()}
    assert share["DS1"]["total"] == 1695833


def test_value_counts_order(spark):
    vc = [r["sentiment_label"] for r in stats.value_counts(
        _rows(spark).where(F.col("source_dataset") == "DS3"), "sentiment_label").collect()]
    assert vc == ["neutral", "positive", "negative"]
