import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from moodspark.llm import components, ngram_join, queries
from tests.llm import helpers as H

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def shingle_set(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def brute(rows, percent=85, width=4):
    sets, held, up = [shingle_set(t, width) for _, t in rows], defaultdict(list), {}

    def of(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        if d is None:
            continue
        of(d)
        both = Counter(j for s in sets[i] for j in held[s])
        for s in sets[i]:
            held[s].append(i)
        for j, c in both.items():
            a, b = of(d), of(rows[j][0])
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and a != b:
                up[max(a, b)] = min(a, b)
    return Counter((d, len(sets[i]), None if d is None else of(d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("percent,width,chunk", [(85, 4, 512), (85, 4, 8), (80, 5, 16), (60, 2, 8)])
def test_against_brute_force(spark, percent, width, chunk, monkeypatch):
    """Also with groups that are split into chunks and parts."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "PART", chunk)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0 if chunk == 8 else 1 << 24)
    rows = H.near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in ngram_join.join_ngrams(df, percent, width).collect()) == brute(rows, percent, width)


def test_query(spark, sf_small):
    got = Counter(tuple(r) for r in queries.QUERIES["op8_ngram_jaccard_join"](spark, sf_small).collect())
    assert got == brute(H.documents(sf_small))


def test_tree_drops_no_pair_that_links():
    rng = np.random.default_rng(3)
    m = ngram_join.Measure(85, 4)
    for n in (2, 17, 300):
        base = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
        sets = []
        for _ in range(n):
            own = np.where(rng.random(60) < rng.choice([0, .03, .1, .5]), rng.integers(0, 2 ** 63, 60).astype(np.uint64), base)
            sets.append(np.unique(own[:rng.integers(40, 61)]))
        size = np.array([len(s) for s in sets])
        maps = [ngram_join.bitmap(s, ngram_join.bitmap_bits(len(s))).tobytes() for s in sets]
        label = rng.integers(0, 5, n) if n == 300 else np.arange(n)
        got = {tuple(sorted(p)) for i, j in ngram_join.may_link(size, maps, label, m) for p in zip(i.tolist(), j.tolist(), strict=True)}
        for a in range(n):
            for b in range(a):
                links = m.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
                assert not links or label[a] == label[b] or (b, a) in got
                assert label[a] != label[b] or (b, a) not in got


def test_keep_one(spark):
    rows = H.near_copies()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = ngram_join.keep_one(df, 80, 5)
    assert got.columns == df.columns
    heads = {(d, c) for d, _, c in brute(rows, 80, 5) if d is not None and d == c}
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(d for d, _ in heads)
    assert got.where("doc_id IS NULL").count() == 2


def test_edges(spark):
    rows = [(d, t) for d, t, *_ in H.EDGES]
    got = Counter(tuple(r) for r in ngram_join.join_ngrams(H.edge_rows(spark, "row", "node", "token", "bucket")).collect())
    assert got == brute(rows)
    assert ngram_join.join_ngrams(H.empty_table(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(300)]
    links += [(5, 5), (7, 6)]
    up = {}

    def of(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = of(a), of(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: of(x) for x in up if of(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
