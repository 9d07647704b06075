import hashlib
import random

import numpy as np
import pytest

from moodspark.llm import edit_fingerprint as fp
from moodspark.llm import queries
from tests.llm import helpers as H


M = 1 << 64


def mix(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 % M
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 % M
    return x ^ x >> 32


def named(part):
    """The hash of some characters."""
    out = 0
    for i, c in enumerate(part):
        out = (out + (ord(c) + 9) * int(fp._STEPS[0]) * pow(int(fp._STEP), i, M)) % M
    return mix((out + len(part)) % M)


def cut(text):
    """Chunks by a character-by-character look at what ends at each place."""
    def marked(end):
        if end < 8:
            return False
        h = [(ord(c) * int(fp._STEP) + 1) % M for c in text[end - 8:end]]
        width = 1
        while width < 8:
            h = [(h[i] * pow(0xD1342543DE82EF95, width, M) + h[i + width]) % M for i in range(len(h) - width)]
            width *= 2
        return mix(h[0]) % 16 == 0

    out, start = [], 0
    for end in range(1, len(text) + 1):
        if marked(end) or end == len(text):
            out += [text[i:min(i + 32, end)] for i in range(start, end, 32)]
            start = end
    return out


def plain_walk(chunk):
    """One chunk's walk, a step at a time: the bits of each band."""
    at, bits = 0, [0] * fp.BANDS
    for step in range(max(map(max, fp.SAMPLED)) + 1):
        h = (ord(chunk[at]) + int(fp._STEPS[step])) * int(fp._STEP) % M
        h ^= h >> 29
        for band, steps in enumerate(fp.SAMPLED):
            if step in steps:
                bits[band] |= (h >> 40 & 1) << steps.index(step)
        at = (at + (h >> 17 & 1)) % len(chunk)
    return bits


def plain_print(text):
    best = {}
    for chunk in cut(text):
        mark = named(chunk[-8:])
        for band, bits in enumerate(plain_walk(chunk)):
            order = mix((mark + (band + 1) * int(fp._STEP)) % M)
            slot, value = band * 16 + order % 16, (order >> 16, bits)
            best[slot] = min(best.get(slot, value), value)
    return [best[i][1] | 1 << 15 if i in best else 0 for i in range(fp.BINS)]


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    far = sum((x ^ y).bit_count() if x and y else 7.5 for x, y in used)
    return max(0.0, 1 - 2 * far / (15 * len(used))) if used else 1.0


def test_fingerprints_equal_a_plain_walk():
    rnd = random.Random(3)
    texts = ["", "a", "short", "é😀" * 50, "z" * 500, "".join(rnd.choice("ab c日") for _ in range(700))] + [
        "".join(rnd.choice("abcdefgh ij") for _ in range(rnd.randrange(400))) for _ in range(30)]
    got = fp.fingerprints(texts)
    for t, row in zip(texts, got):
        assert row.tolist() == plain_print(t)
    for x, y in zip(got, got[1:]):
        assert abs(fp.likeness(x[None], y[None])[0] - plain_likeness(x.tolist(), y.tolist())) < 1e-12


def expected(rows):
    """The rows by one list in order (null ids first, ties by text)."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 4
        e = t[:len(t) - k] + after[:k]
        a, b, c = fp.fingerprints([t, e, after])
        near = [float(fp.likeness(a[None], x[None])[0]) for x in (b, c)]
        bands = sum(1 for i in range(0, 64, 2) if (a[i:i + 2] == b[i:i + 2]).all() and a[i:i + 2].any())
        links = [n >= .5 and (not (a.any() or x.any()) or any((a[i:i + 2] == x[i:i + 2]).all() and a[i:i + 2].any() for i in range(0, 64, 2)))
                 for n, x in zip(near, (b, c))]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), *near, bands, *links))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 7])
def test_edges_in_order(spark, blocks, monkeypatch):
    monkeypatch.setattr(fp, "shuffle_partitions", lambda _: blocks)
    monkeypatch.setattr(fp, "SLICE", 3000)
    got = fp.fingerprint_documents(H.edge_rows(spark, "block", "extra", "fingerprint")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected([(d, t) for d, t, *_ in H.EDGES])
    one = spark.createDataFrame([(5, "only one here")], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprint_documents(one).collect()] == expected([(5, "only one here")])
    assert fp.fingerprint_documents(H.empty_table(spark)).count() == 0


def test_query(spark, sf_small):
    rows = queries.QUERIES["op7_document_fingerprints"](spark, sf_small).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expected(H.documents(sf_small))
    longer = [r for r in rows if r["n_chars"] >= 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in longer]) >= 0.95


def test_edits_cost_likeness_in_proportion():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(3000)) for _ in range(20)]

    def changed(t, k):
        s = list(t)
        for _ in range(k):
            i = rnd.randrange(len(s))
            s[i:i + 1] = rnd.choice([["q"], [], [s[i], "z"]])
        return "".join(s)

    means = [fp.likeness(fp.fingerprints(texts), fp.fingerprints([changed(t, k) for t in texts])).mean() for k in (0, 2, 20, 200)]
    assert means[0] == 1.0 and means[1] > 0.9 and means[1] > means[2] > means[3]
    assert fp.likeness(fp.fingerprints(texts), fp.fingerprints(texts[1:] + texts[:1])).mean() < 0.15


def test_distance_grows_with_edits_inside_chunks():
    """Single edits change some of a chunk's bits, not all: what bits measure beyond equal chunks."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(4000)) for _ in range(10)]
    every = ["".join(c if i % 40 else "#" for i, c in enumerate(t)) for t in texts]
    a, b = fp.fingerprints(texts), fp.fingerprints(every)
    both = (a > 0) & (b > 0)
    equal, bits = (a == b)[both].mean(), 1 - np.bitwise_count(a.astype(int) ^ b.astype(int))[both].mean() / fp.BITS
    assert equal < .75 and bits > equal + .1


def test_near_links_and_their_recall(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(2000)) for _ in range(4)]
    rows = []
    for i in range(80):
        t = list(base[i % 4])
        for _ in range(rnd.choice([0, 1, 3, 6, 12])):
            t[rnd.randrange(len(t))] = rnd.choice(["q", "", "zz"])
        rows.append((i, "".join(t)))
    rows += [(100 + i, "".join(rnd.choice("abcdef ") for _ in range(2000))) for i in range(10)] + [(190, ""), (191, None)]
    prints = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    links = fp.near_links(prints).collect()
    own = {r["doc_id"]: np.frombuffer(bytes.fromhex(r["fingerprint"]), ">u2") for r in prints.collect()}
    up = {d: d for d in own}

    def of(d):
        while up[d] != d:
            d = up[d]
        return d

    for r in links:
        assert r["doc_id"] > r["other"]
        assert abs(r["likeness"] - plain_likeness(own[r["doc_id"]].tolist(), own[r["other"]].tolist())) < 1e-9 and r["likeness"] >= .5
        up[of(r["doc_id"])] = of(r["other"])
    alike = [(a, b) for a in own for b in own if a < b < 190 and plain_likeness(own[a].tolist(), own[b].tolist()) >= .5]
    assert len(alike) > 500 and sum(of(a) == of(b) for a, b in alike) / len(alike) >= .99
    assert all(of(100 + i) == 100 + i for i in range(10))


def test_very_long_texts(spark):
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcdefgh ij") for _ in range(1_500_000))
    rows = [(1, t), (2, t[:700_000] + "x" + t[700_000:]), (3, "w" * 1_000_000), (4, "a b " * 400_000)]
    got = {r.doc_id: r for r in fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > .9 and got[1].linked_next and got[2].near_next < .2 and not got[2].linked_next
