import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from moodspark.llm import packing, queries
from tests.llm import helpers as H

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


def test_identifiers_are_the_library_s(library):
    rnd = random.Random(1)
    parts = [*"ab  \n\t\0é漢😀'<s>​́　sfs½²١٣İſK_-!?$\x85\x1c᠎", "<|endoftext|>", "the ", "   ", "'re", "'LL", "\r\n"]
    encode = packing.encoder(TOKENIZER)
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts, library, capacity=1024, end=2):
    """Pieces are cut as stated, sequences are gapless, and every text is packed once."""
    place, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append(r)
    for held in place.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc, text in texts:
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(place)


def test_query(spark, sf_small, library):
    rows = queries.QUERIES["op3_best_fit_packing"](spark, sf_small).collect()
    n = check(rows, H.documents(sf_small), library)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 2


def test_edges_and_salted_ranks(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)   # many buckets for one length
    df = H.edge_rows(spark, "length", "salt", "rank", "offset")
    df = df.unionByName(df).unionByName(df)
    check(packing.pack(df, TOKENIZER, 2, 64).collect(), [(d, t) for d, t, *_ in H.EDGES * 3], library, 64)
    assert packing.pack(H.empty_table(spark), TOKENIZER).count() == 0


def fewest(lengths, capacity):
    """The least number of sequences, by trying all (small inputs)."""
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                put(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_reduction_loses_nothing():
    """After fixing dominating sets the rest can still reach the optimum."""
    rnd = random.Random(3)
    for _ in range(150):
        lengths = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce(dict(Counter(lengths)), 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for _, t in fixed) + fewest(rest, 20) == fewest(lengths, 20), lengths
        assert Counter(w for c, t in fixed for w in c * t) + Counter(rest) == Counter(lengths)


def test_dominance_by_definition():
    """Each set fixed dominates: any other set's members fit into its own."""
    def inside(members, room):
        if not members:
            return True
        return any(m <= r and inside(members[1:], room[:i] + [r - m] + room[i + 1:]) for m in members[:1] for i, r in enumerate(room))

    rnd = random.Random(5)
    for _ in range(300):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 8))]
        j = rnd.choice(lengths)
        chosen = packing.dominating(packing._Counts(dict(Counter(lengths))), j, 20)
        if chosen:
            others = list((Counter(lengths) - Counter([j])).elements())
            for k in range(len(others) + 1):
                for c in combinations(others, k):
                    if sum(c) + j <= 20:
                        assert inside(sorted(c, reverse=True), list((Counter(chosen) - Counter([j])).elements())), (lengths, j, chosen, c)


def test_plan_covers_counts_of_any_size():
    rnd = random.Random(2)
    for scale in (1, 1000, 10 ** 9):
        counts = {k: v * scale for k, v in Counter(rnd.randint(1, 1024) for _ in range(3000)).items()}
        runs = packing.plan(counts, 1024)
        assert len(runs) < 20_000
        got = Counter()
        for length, a, b, *_ in runs:
            got[length] += b - a
        assert got == Counter(counts)
