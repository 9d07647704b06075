"""AGG6 by a sketch, and AGG7 while writing."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodspark.operators import stats
from moodspark.session import scratch_path


def top(counts, k):
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("shape, k, tracked, proven", [
    ("zipf", 20, 8000, True), ("zipf", 20, 64, None), ("flat", 10, 100, False), ("few", 50, 1000, True), ("ties", 5, 5000, None)])
def test_the_most_frequent_equal_a_full_count(spark, shape, k, tracked, proven):
    rnd = random.Random(k)
    make = {"zipf": lambda: f"w{int(rnd.paretovariate(.9)) % 20_000}", "flat": lambda: f"w{rnd.randrange(20_000)}",
            "few": lambda: f"w{rnd.randrange(9)}", "ties": lambda: f"w{len(words) % 300}"}[shape]
    words = []
    for _ in range(30_000):
        words.append(make())
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string").repartition(7)
    got, sufficed = stats.frequent(df, "word", k, tracked)
    assert [(r.word, r.n) for r in got.collect()] == top(Counter(words), k)
    assert proven is None or sufficed == proven


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None,)], "word string")
    assert stats.frequent(df, "word", 3)[0].count() == 0 and stats.frequent(df.limit(0), "word", 3)[0].count() == 0


def test_counts_while_writing_equal_the_funnel(spark):
    rows = [(i, "s" + str(i % 3), f"{'RT ' if i % 5 == 0 else ''}text {i % 40}" + " more words" * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tweet string").repartition(6)
    stages = [("no_retweet", ~F.col("tweet").startswith("RT ")), ("long", F.size(F.split("tweet", " ")) >= 3)]
    path = scratch_path(spark, "funnel")
    got = stats.write_with_funnel(df, "tweet", ["source", "doc_id"], stages, lambda r: r.write.parquet(path))
    want = stats.deduplicated_funnel(df, "tweet", ["source", "doc_id"], stages).first().asDict()
    assert got == want and spark.read.parquet(path).count() == got["n_long"] > 0
