import random

from moodspark.llm import components as C


def brute(links):
    up = {x: x for ab in links for x in ab}

    def of(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((of(a), of(b)))
        up[y] = x
    return {x: of(x) for x in up if of(x) != x}


def test_both_ways_equal_union_find(spark, monkeypatch):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(40, 120)]
    star = [(500, 501 + i) for i in range(60)]
    some = [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    links = chain + star + some + [(7, 7), (-3, 2 ** 40), (2 ** 40, 5)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for most in (1 << 18, 0):
        monkeypatch.setattr(C, "ONE_TASK", most)
        assert {r.node: r.component for r in C.components(df).collect()} == brute(links)
    monkeypatch.setattr(C, "ONE_TASK", 1 << 18)
    assert C.components(df.limit(0)).count() == 0
