import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from moodspark.llm import mixing, queries
from tests.llm.helpers import DOCS, duck, edge_rows, empty_table, same_as_sql

WORDS = re.compile(mixing.WORD)


def brute_targets(size):
    """Share by weight, stop at twice a source's size, share the excess again."""
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(size.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * size[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2 * size[s]
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def check(df, near=None):
    """Every row of the shares against the definition; ``near``: allowed distance from a target."""
    docs = [r for r in df.collect()]
    got = mixing.shares(df).collect()
    size = {}
    for r in docs:
        size[r.source] = size.get(r.source, 0) + len(WORDS.findall(r.text or ""))
    target = brute_targets(size)
    want = sorted((repr(r.doc_id), len(WORDS.findall(r.text or "")), size[r.source], float(target[r.source])) for r in docs)
    have = sorted((repr(r.doc_id), r["size"], r.source_size, r.target) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert [w[3] for w in want] == pytest.approx([h[3] for h in have], rel=1e-12)
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r["size"] * r.times <= 2 * r["size"] and r.times in (int(rate), int(rate) + (rate % 1 > 0))
    if near is not None:
        taken = {}
        for r in got:
            taken[r.target, r.source_size] = taken.get((r.target, r.source_size), 0) + r.taken
        for (t, n), v in taken.items():
            assert abs(v - t) <= near * max(t, 1)
    return got


def corpus(n, sources, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = sources[0] if rnd.random() < .4 else rnd.choice(sources)
        rows.append((i, " \t".join("w" for _ in range(int(rnd.lognormvariate(3, 1.5)))), "en", s, 0))
    return rows


def test_targets_and_near_totals(spark):
    check(spark.createDataFrame(corpus(3000, ["b", "a", "", None, "Z", "é", "z", "aa", "c1"]), DOCS).repartition(5), near=.01)


def test_sources_that_stop_at_twice_their_size_in_turn(spark):
    rows = [(i, "x " * n, "en", f"s{i:02}", 0) for i, n in enumerate([1, 2, 4, 9, 20, 44, 100, 230, 500, 1200, 3000, 0])]
    check(spark.createDataFrame(rows, DOCS))


def test_edges_clashing_names_and_long_texts(spark):
    check(edge_rows(spark, "key", "size", "turn", "start", "target"))
    assert mixing.shares(empty_table(spark)).count() == 0
    assert mixing.mix(empty_table(spark)).count() == 0
    rows = [(1, "a " * 1_000_000, "en", "s", 0), (2, "b" * 2_000_000, "en", None, 0), (None, None, None, None, None)] * 2
    check(spark.createDataFrame(rows, DOCS))


def test_reruns_and_partitions_agree_and_the_mix_holds_the_copies(spark):
    df = spark.createDataFrame(corpus(800, ["a", "b", "c", "d"], 2), DOCS).withColumn("_times", F.lit(1)).withColumn("key", F.lit("k"))
    a, b = (sorted(map(repr, mixing.shares(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b
    held = {r.doc_id: r.n for r in mixing.mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert held == {r.doc_id: r.times for r in mixing.shares(df).collect() if r.times}
    assert mixing.mix(df).columns == df.columns + ["_copy"]


def test_draws_have_the_fraction_as_probability(spark):
    """At any one start, whole numbers of ids fall into an arc as its length says."""
    hits = spark.range(40_000).select(mixing.turn(F.col("id")).alias("t")).collect()
    for start, length in ((0, .1), (.7, .5), (.33, .9)):
        inside = sum(((r.t / mixing.STARTS - start) % 1) < length for r in hits)
        assert abs(inside / 40_000 - length) < .01


def test_salted_join_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(corpus(300, ["a", "b", None], 3), DOCS)
    want = sorted(map(repr, mixing.shares(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(mixing, "SALTS", 4)
    assert sorted(map(repr, mixing.shares(df).collect())) == want


def test_query_equals_its_sql(spark, sf_small):
    same_as_sql(queries.QUERIES["op12_mixing_to_weights"](spark, sf_small), duck(sf_small), queries.ORACLE["op12_mixing_to_weights"])
