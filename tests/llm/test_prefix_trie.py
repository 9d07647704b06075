import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from moodspark.llm import prefix_trie as pt
from moodspark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, family=5):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((t is not None, t or 0, said), (role, text)))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own if base == c else convs.get(base, [])[:h] + own[h:]
    return out


def brute(rows, family=5):
    nodes = {}
    for c, path in rebuilt(rows, family).items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append((c, len(path) == d))
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[k] for k in below)
    return sorted((min(c for c, _ in m), len(key), min(c for c, _ in nodes[key[:-1]]) if key else None, len(m), len(kids.get(key, [])),
                   leaves[key], saved[key], hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest())
                  for key, m in nodes.items())


def check(df, rows, **settings):
    got = [tuple(r) for r in pt.trie(df, **settings).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert sorted(got) == brute(rows, settings.get("family", 5))


def talk(n, seed=1, longest=12):
    """Conversations with common first turns, copies, missing first members and empty ones."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-n // 5, 2 * n), n):
        if rnd.random() < .3 and rows:
            rows += [(c, t, r, x) for o, t, r, x in rows if o == rows[-1][0]]
            continue
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, None if t == 0 and rnd.random() < .2 else t, rnd.choice(["user", "assistant", None]),
                         rnd.choice(["yes", "é" * 9, "", None, f"w{rnd.randrange(4)}"]) if rnd.random() < .7 else f"{c} {t}"))
    return rows


@pytest.mark.parametrize("levels, min_heavy, queue_rows", [(4096, 64, 200_000), (3, 2, 4), (1, 1, 2), (2, 10 ** 9, 3)])
def test_equals_brute_force(spark, levels, min_heavy, queue_rows):
    rows = talk(150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"unit": F.lit(1), "key": F.lit("k"), "x": F.lit("x")})
    check(df, rows, levels=levels, min_heavy=min_heavy, queue_rows=queue_rows)


def test_conversations_longer_than_partitions(spark):
    """Two long ones that share a long beginning, over many partitions, bands and rounds."""
    rows = ([(c, t, "user", f"{t % 7}" if t < 90 + c else f"{c} {t}") for c in (10, 11, 13, 27) for t in range(180)]
            + [(c, t, "a", f"{t}") for c in (12, 25, 14) for t in range(3)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(df, rows, levels=32, min_heavy=2)
        check(df, rows, levels=4096)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_edges(spark):
    assert pt.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (4, 1, "u", ""), (5, 1, "u", ""), (6, 1, "u", "x" * 2_000_000),
            (7, 1, "u", "x" * 2_000_000), (9, 2, "u", "b"), (9, 1, "u", "a"), (9, 1, "u", "a"), (-1, 1, "u", "n"), (-5, 0, "u", "n")]
    check(spark.createDataFrame(rows, SCHEMA), rows)
    check(spark.createDataFrame(rows, SCHEMA), rows, family=1)


def test_partitions_hand_paths_on():
    """Every way to cut one conversation in three gives the keys of the uncut one."""
    xs = [hashlib.md5(str(i).encode()).digest() for i in range(23)]
    base = [(hashlib.md5(b"base" + bytes([i])).digest(), i) for i in range(8)]
    for conv, have in ((7, 8), (8, 3), (13, 8), (14, 1), (21, 0)):
        whole = pt.Path(conv, conv - conv % 5, base[:have], 4)
        for x in xs:
            whole.turn(x, 1)
        whole.close(True)
        want = b"".join(p[5] for p in whole.done)
        for a in range(1, 22):
            parts = [xs[:a], xs[a:a + 3], xs[a + 3:]]
            tails = [(i, pt.Tail(conv, conv, conv - conv % 5, len(p), pt._fold(0, p), p[-12:], p[:8], base[:have] if i == 0 else []))
                     for i, p in enumerate(parts)if p]
            known, goes_on = pt.entering(tails, 4)
            assert goes_on == {i for i, _ in tails[:-1]}
            pieces = []
            for i, _ in tails:
                path = pt.Path(conv, conv - conv % 5, base[:have], 4) if i == 0 else pt.Path.resume(known[i], known[i].base, 4)
                for x in parts[i]:
                    path.turn(x, 1)
                path.close(i not in goes_on)
                pieces += path.done
            assert b"".join(p[5] for p in pieces) == want
            for p in pieces:
                held = p[4] + p[5]
                start = (p[1] - len(p[4]) // 16 - 1) * 16
                assert held == want[start:start + len(held)]
                assert p[3] == (want[start - 16:start] if start else pt._key(pt.ROOT))


def test_spilling_queue_is_a_priority_queue():
    rnd, q = random.Random(2), pt.SpillingQueue(5)
    want = [(rnd.randrange(-9, 0), rnd.randrange(4), i) for i in range(200)]
    for x in want:
        q.push(x)
    assert len(q.runs) > 3
    got = [x for d in range(-9, 0) for k in range(4) for x in q.pop_of((d, k))]
    assert got == sorted(want) and not len(q)


def test_query_equals_brute_force(spark, sf_small):
    t = spark.read.parquet(f"{sf_small}/conversations.parquet").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op13_conversation_trie"](spark, sf_small).collect())
    assert got == brute([tuple(r) for r in t])
