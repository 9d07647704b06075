import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from moodspark.llm import decontaminate, queries
from tests.llm import helpers as H


def words(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256)))
    return re.findall(rb"[0-9a-z'\x80-\xff]+", low)


def shingled(w, width):
    return [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]


def brute(docs, items, least=0.8):
    """The best similarity of any window of each document to each item it shares a shingle with."""
    best = {}
    held = defaultdict(set)
    sets = {}
    for i, t in items:
        w = words(t)
        if w:
            sets[i] = (min(5, len(w)), Counter(shingled(w, min(5, len(w)))))
            for s in sets[i][1]:
                held[s].add(i)
    for d, t in docs:
        w = words(t)
        for width in {x for x, _ in sets.values()}:
            s = shingled(w, width)
            for i in {i for x in s for i in held.get(x, ()) if sets[i][0] == width}:
                counts = sets[i][1]
                size = min(sum(counts.values()), len(s))
                for k in range(len(s) - size + 1):
                    c = Counter(s[k:k + size])
                    both = sum(min(n, c[x]) for x, n in counts.items())
                    alike = both / (size + sum(counts.values()) - both)
                    if alike >= least and alike > best.get((d, i), 0):
                        best[d, i] = alike
    return best


def test_query(spark, sf_small):
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.QUERIES["op6_benchmark_decontamination"](spark, sf_small).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_small}/benchmark.parquet'").fetchall()
    want = brute(H.documents(sf_small), items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2
DOCS = [
    (1, "before it " + ITEM + " after it"), (2, ITEM.upper().replace(" ", ", ")), (3, ITEM.replace("theta iota", "theta new", 1)),
    (4, " ".join(ITEM.split()[::-1])), (5, " ".join(ITEM.split()[:44])), (6, " ".join(ITEM.split()[:20])), (7, "short one"),
    (8, "a short One!"), (9, ITEM + ITEM), (10, None), (11, ""), (12, "alpha beta gamma delta epsilon"), (1, "before it " + ITEM + " after it"),
]
ITEMS = [(1, ITEM), (2, "short one"), (3, None), (4, ""), (5, "!!!"), (2, "short one")]


@pytest.mark.parametrize("block", [decontaminate.ITEM_BYTES, 64])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", block)   # one block of items, or several
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.matches(docs, items).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    want = brute(DOCS, ITEMS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert (8, 2) in want and (5, 1) in want and (6, 1) not in want
    clean = decontaminate.keep_clean(docs, items).collect()
    assert sorted(r["doc_id"] for r in clean) == sorted(d for d, _ in DOCS if d not in {k[0] for k in want})


def test_edges(spark):
    items = spark.createDataFrame([(1, "same text here now"), (2, "w " * 40)], "item_id long, text string")
    df = H.edge_rows(spark, "item_id", "similarity")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, items).collect()} == {(7, 1), (8, 2)}
    assert decontaminate.keep_clean(df, items).columns == df.columns
    assert decontaminate.matches(H.empty_table(spark), items).count() == 0
    assert decontaminate.matches(df, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(df, items.limit(0)).count() == len(H.EDGES)


def index_of(items):
    held = [(i, decontaminate.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for i, t in items]
    return decontaminate.Items([i for i, _ in held], [w for _, w in held], .8)


def search(index, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return [f for _, hits in decontaminate.search_texts(index, data, np.array([0, len(data)])) for f in hits]


def test_buckets_list_all_within_the_radius():
    rng = np.random.default_rng(1)
    group = decontaminate.SameSize(np.arange(500), rng.integers(0, 2 ** 63, 500, dtype=np.uint64) * 2, 5, 9)
    prints = []
    for n in range(64):
        flip = rng.choice(64, n % 30, replace=False)
        prints.append(int(group.prints[n * 7]) ^ sum(1 << int(b) for b in flip))
    window, item, distance = group.near(np.array(prints, np.uint64))
    want = {(w, i) for w in range(64) for i in range(500) if (prints[w] ^ int(group.prints[i])).bit_count() <= decontaminate.RADIUS}
    assert set(zip(window.tolist(), item.tolist())) == want
    assert all((prints[w] ^ int(group.prints[i])).bit_count() == d for w, i, d in zip(window, item, distance))


def test_an_item_that_the_tables_do_not_list_is_not_found():
    other = " ".join(f"w{i}" for i in range(len(ITEM.split())))
    index = index_of([(1, ITEM), (2, other)])
    text = "before " + ITEM + " then " + other
    assert [f[0] for f in search(index, text)] == [0, 1]
    group = index.sizes[0]
    # both items are of one size; the first one's entries are pointed at the second
    group.order[group.order == 0] = 1
    assert [f[0] for f in search(index, text)] == [1]


def test_recall_at_the_radius():
    """Windows edited to a similarity just over the least are within the radius."""
    rnd = random.Random(5)
    found = tried = 0
    for k in range(300):
        w = [f"x{rnd.randrange(10 ** 6)}" for _ in range(rnd.randrange(40, 160))]
        index = index_of([(1, " ".join(w))])
        v = list(w)
        for at in rnd.sample(range(len(v)), max(1, len(v) // 50)):
            v[at] = "new"
        if brute([(1, " ".join(v))], [(1, " ".join(w))]):
            tried += 1
            found += bool(search(index, " ".join(v)))
    assert tried > 150 and found == tried


def test_very_long_texts_and_items(spark):
    rnd = random.Random(2)
    filler = " ".join(f"f{rnd.randrange(5000)}" for _ in range(250_000))
    item = " ".join(f"i{rnd.randrange(10 ** 6)}" for _ in range(3000))
    docs = spark.createDataFrame([(1, filler + " " + item + " " + filler), (2, filler), (3, ITEM * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(1, 7), (3, 8)}
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == [2]
