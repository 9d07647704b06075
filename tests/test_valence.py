"""LAB1 with all rules, against sentences worked by hand."""

import math
import random

import pytest

from moodspark.operators import lexicon, valence

WORDS = [("good", 1.9), ("great", 3.1), ("love", 3.2), ("bad", -2.5), ("hate", -2.7), ("fine", 0.8), ("kick", -0.6)]
IDIOMS = [("kick the bucket", -1.5), ("kick the bucket list", 2.0), ("bad  ass", 1.5), ("cut corners", -1.2)]

BY_HAND = [
    ("", 0.0), (None, 0.0), ("nothing here", 0.0), ("good", 1.9), ("(good)", 1.9), ("Good, really.", 1.9),
    ("very good", 1.9 + .293), ("very bad", -2.5 - .293), ("barely good", 1.9 - .293),
    ("really not good", (1.9) * -.74 + .293 * .95 * -1),          # negated first, then boosted on its new side
    ("not very good", (1.9 + .293) * -.74), ("never so good", (1.9 + .293) * 1.5),
    ("never this bad", -2.5 * 1.5), ("never so very good", ((1.9 + .293) + .293 * .95) * 1.25),
    ("a GOOD day", 1.9 + .733), ("GOOD DAY", 1.9), ("a BAD day", -2.5 - .733), ("VERY good day", 1.9 + .293 + .733),
    ("VERY bad day", -2.5 - .293 - .733), ("good but bad", 1.9 * .5 - 2.5 * 1.5), ("fine but", .8 * .5), ("but good", 1.9 * 1.5),
    ("good!", 1.9 + .292), ("good!!!!!!", 1.9 + 4 * .292), ("bad!!", -2.5 - 2 * .292), ("good?", 1.9), ("good??", 1.9 + 2 * .18),
    ("bad????", -2.5 - .96), ("what!!", 0.0), ("great love", 3.1 + 3.2), ("good good", 3.8), ("not bad not good", 2.5 * .74 + 1.9 * .74 * .74),
    ("he may kick the bucket", -1.5), ("my Kick The Bucket list", 2.0), ("kick the  bucket lists", -1.5), ("a kick", -.6),
    ("bad ass", 1.5), ("not bad ass", 1.5 * -.74), ("bad\tASS day", 1.5), ("cut cornersx", 0.0), ("very cut corners", -1.2 - .293),
    ("good great", 5.0), ("not great good", 3.1 * -.74 + 1.9 * -.74),
]


def score(s):
    return s / math.sqrt(s * s + 15)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(WORDS, "word string, valence double"), spark.createDataFrame(IDIOMS, "idiom string, valence double")


def test_sentences_worked_by_hand(spark, tables):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BY_HAND)], "id int, text string").repartition(3)
    got = {r.id: r.sentiment_score for r in valence.valence_score(df, "id", "text", *tables).collect()}
    wrong = [(t, got[i], score(s)) for i, (t, s) in enumerate(BY_HAND) if abs(got[i] - score(s)) > 1e-9]
    assert not wrong and len(got) == len(BY_HAND)


def plain(text):
    """The rules again, a word at a time."""
    words_, vals = [], dict(WORDS)
    raw, phrases = text.split(), sorted(((p.split(), v) for p, v in IDIOMS), key=lambda x: -len(x[0]))
    i = 0
    while i < len(raw):
        for p, v in phrases:
            if [w.lower() for w in raw[i:i + len(p)]] == p:
                words_.append("_".join(raw[i:i + len(p)]))
                vals["_".join(p)] = v
                i += len(p)
                break
        else:
            words_.append(raw[i])
            i += 1
    c = valence.Context()
    loud = [w.upper() == w != w.lower() for w in words_]
    shouted = 0 < sum(loud) < len(words_)
    low = [w.lower() for w in words_]
    total = 0.0
    for i, w in enumerate(low):
        if w not in vals or w in c.boosters:
            continue
        v = vals[w]
        if loud[i] and shouted:
            v += math.copysign(.733, v)
        for k in (1, 2, 3):
            if i < k or low[i - k] in vals:
                continue
            p, factor = low[i - k], (1, .95, .9)[k - 1]
            b = c.boosters.get(p, 0)
            if b:
                v += ((-b if v < 0 else b) + ((.733 if v > 0 else -.733) if loud[i - k] and shouted else 0)) * factor
            if p == "never" and k > 1 and any(x in c.stress for x in low[i - k + 1:i]):
                v *= 1.5 if k == 2 else 1.25
            elif p in c.negators:
                v *= -.74
        if "but" in low:
            v *= .5 if i < low.index("but") else 1.5
        total += v
    return score(total)


def test_random_word_rows_equal_a_plain_restatement(spark, tables):
    rnd = random.Random(4)
    some = ["good", "GREAT", "love", "bad", "hate", "kick", "the", "bucket", "list", "ass", "cut", "corners", "very", "SO", "this", "never", "not",
            "but", "barely", "day", "X"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for r in valence.valence_score(df, "id", "text", *tables).collect():
        assert abs(r.sentiment_score - plain(texts[r.id])) < 1e-9, texts[r.id]


def test_without_idioms_and_with_a_long_text(spark, tables):
    df = spark.createDataFrame([(1, "good day " * 100_000), (2, "kick the bucket")], "id int, text string")
    got = {r.id: r.sentiment_score for r in valence.valence_score(df, "id", "text", tables[0]).collect()}
    assert abs(got[1] - score(190_000.0)) < 1e-9 and abs(got[2] - score(-.6)) < 1e-9
    assert lexicon.POSITIVE_AT == .05
