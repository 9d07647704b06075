import random
import re

import regex

from pyspark.sql import functions as F

from moodspark.llm import pii, queries
from tests.llm import helpers as H

ROWS = [
    (1, "Mr. John Smith met Mrs Anna Smith. Mr Smith called +1 (017) 555-7713 or 555-123-4567, ssn 123-45-6789."),
    (2, "card 4111 1111 1111 1111, bad 4111111111111112; ip 10.0.0.1 999.1.1.1; mail bob.x+1@Mail7.example.com, ñdo.55@пример.рф"),
    (3, None), (4, ""), (5, "г-жа Иванова и г-н Иван Петров, IBAN DE89 3704 0044 0532 0130 00 x"), (6, "Mr. John Smith at 10.0.0.1"),
    (6, "Mr. John Smith at 10.0.0.1"), (None, "ip 8.8.8.8."), (8, "no entities, 12 of 345, v1.2.3"),
]


def run(spark, rows, key="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return pii.pseudonymise(df, key).collect()


def entities(text):
    """A plain restatement for the kinds with simple forms."""
    return re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d])|(?<!\w)\d{16}(?!\w)|\+\d \(\d{3}\) \d{3}-\d{4}", text or "")


def shape(s):
    return re.sub("[a-zà-ÿ]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))


def test_forms_and_coreference(spark):
    out = {r["doc_id"]: r for r in run(spark, ROWS)}
    one = out[1]["text"]
    name = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr (\w+) called (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}), ssn (\d{3}-\d{2}-\d{4})\.$", one)
    assert name and name[2] == name[4] == name[5] != "Smith"           # one surname, one surrogate
    assert name[1] in pii.GIVEN["latin", "male"] and name[3] in pii.GIVEN["latin", "female"]
    assert f"Mr. {name[1]} {name[2]} at " in out[6]["text"]              # across documents
    two = re.match(r"card (\d{4} \d{4} \d{4} \d{4}), bad (\d{16}); ip ([\d.]+) 999\.1\.1\.1; mail (\S+)\.com, (\S+)\.рф$", out[2]["text"])
    assert spark.range(1).select(F.call_function("luhn_check", F.lit(two[1].replace(" ", "")))).first()[0]
    assert shape(two[4]) == shape("bob.x+1@Mail7.example")
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[а-я]{6}", two[5])             # scripts stay
    assert re.match(r"г-жа [А-Я][а-я]+ и г-н (\S+) [А-Я][а-я]+, IBAN DE\d\d", out[5]["text"])[1] in pii.GIVEN["cyrillic", "male"]
    assert out[6]["text"].endswith(two[3]) and out[8]["text"] == ROWS[-1][1]
    assert out[3]["text"] == out[4]["text"] == "" and out[None]["n_ip"] == 1 and len(run(spark, ROWS)) == len(ROWS)
    for d, t in ROWS:
        for e in entities(t):
            if e != "999.1.1.1":
                assert e not in out[d]["text"]


def test_key_decides(spark):
    a, b, c = (sorted(map(repr, run(spark, ROWS, k))) for k in ("k", "k", "other"))
    assert a == b != c


def test_distinct_where_room_is_short(spark, monkeypatch):
    """First draws collide, also where there is no room at all: all end up distinct and new."""
    found = [f"{a}{b}1.5.{c}.1" for a in "12" for b in "01" for c in range(10)]
    entities_ = spark.createDataFrame([(e,) for e in found], "entity string")
    for room in (97, 7):
        def narrow(kind, entity, draw, key, room=room):
            return F.concat(F.lit("10.0.0."), (pii.number(pii.keyed(key, entity, draw.cast("string")), 1, room)).cast("string"))

        monkeypatch.setattr(pii, "surrogate", narrow)
        monkeypatch.setattr(pii, "PLAIN_DRAWS", 3)
        got = pii.assign(entities_, "k").collect()
        assert len({r["surrogate"] for r in got}) == len(found) and not {r["surrogate"] for r in got} & set(found)


#: Every kind again, in another engine's terms.
AGAIN = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z][A-Z]\d\d(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("card", r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.[0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}])"),
    ("name", r"(?<![\p{L}\p{N}])(?:Mr|Herr|Señor|Monsieur|г-н|Mrs|Ms|Miss|Frau|Señora|Madame|г-жа)\.? "
             r"\p{Lu}[\p{L}'-]*\p{Ll}(?: \p{Lu}[\p{L}'-]*\p{Ll})?(?![\p{L}\p{N}])"),
]


def spans_of(text):
    """Leftmost, then in the order of the kinds; no two overlap."""
    compiled = [(k, regex.compile(p.replace("\\d", "[0-9]"))) for k, p in AGAIN]
    at, out = 0, []
    while at <= len(text):
        found = [(m.start(), i, m) for i, (_, p) in enumerate(compiled) if (m := p.search(text, at))]
        if not found:
            break
        _, i, m = min(found, key=lambda x: x[:2])
        out.append((compiled[i][0], m.start(), m.end()))
        at = max(m.end(), m.start() + 1)
    return out


def test_all_kinds_equal_a_restatement(spark, sf_small):
    more = [t for _, t in ROWS] + [
        "a.b@c.de, x@y, x@-.co @a.bc", "DE89370400440532013000 GB29 NWBK 6016 1331 9268 19;XX12 3", "Señor Ñandú O'Brien-Smith met Mr. X",
        "1.2.3.4.5 255.255.255.255 256.1.1.1 0.0.0.0", "(030) 1234-5678 +49 30 1234 5678 12-345-6789", "Mrs Mrs Smith Mr Al", "378282246310005"]
    rnd = random.Random(3)
    more += [" ".join(rnd.choice(["Mr", "Frau", "Al", "Bo", "12", "345-67-8901", "4111111111111111", "a@b.co", "9.9.9.9", "+1", "555", "1234", "-"])
                      for _ in range(12)) for _ in range(150)]
    texts = [(i, t) for i, t in enumerate(more + [t for _, t in H.documents(sf_small)])]
    got = {r["doc_id"]: r for r in run(spark, texts)}
    for i, t in texts:
        spans = spans_of(t or "")
        for k in pii.KINDS:
            assert got[i][f"n_{k}"] == sum(s[0] == k for s in spans), (t, k)
        rest = got[i]["text"]
        at = 0
        for _, a, b in spans:  # what stands between entities stays
            gap = (t or "")[at:a]
            assert rest.startswith(gap) or gap in rest
            at = b
        if not spans:
            assert rest == (t or "")


def test_one_surname_has_one_surrogate(spark):
    """All two-letter surnames that there is much demand for, with titles and given names."""
    families = [a + b for a in "ABCDEFGHIJKL" for b in "abcdefghijklm"]
    texts = [(i, f"Mr {f} and Mrs {f}, Mr John {f}, Mr James {f}.") for i, f in enumerate(families)]
    seen, names = {}, {}
    for r in run(spark, texts):
        m = re.fullmatch(r"Mr (\w+) and Mrs (\w+), Mr ([\w-]+) (\w+), Mr ([\w-]+) (\w+)\.", r["text"])
        assert m and m[1] == m[2] == m[4] == m[6] and m[3] != m[5]
        assert shape(m[1])[:2] == "Aa"
        assert set(re.split("-", m[3])) | set(re.split("-", m[5])) <= set(pii.GIVEN["latin", "male"])
        seen[families[r["doc_id"]]] = m[1]
        names[r["doc_id"]] = m[3], m[5]
    assert len(set(seen.values())) == len(families) and not set(seen.values()) & set(families)


def remainder(iban):
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_iban_check_digits_stay_right(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"]
    bad = ["DE88 3704 0044 0532 0130 00"]
    out = {r["doc_id"]: r["text"] for r in run(spark, [(i, f"to {x}.") for i, x in enumerate(good + bad)])}
    for i, x in enumerate(good):
        new = out[i][3:-1]
        assert remainder(x) == 1 == remainder(new) and new != x and shape(new[4:]) == shape(x[4:]) and new[:2] == x[:2]


def test_very_long_texts_and_entities(spark):
    long = [(1, "x@" + "a." * 500_000 + "com"), (2, "q" * 400_000 + "@mail.example.com"), (3, "Mr " + "Ab" * 200_000), (4, "1-" * 600_000),
            (5, "plain words " * 120_000 + "10.1.2.3"), (6, "a@" + "b." * 100 + "de"), (7, "(" * 1_000_000), (8, "a@b" * 400_000)]
    out = {r["doc_id"]: r for r in run(spark, long)}
    assert len(out) == len(long) and out[1]["n_email"] == 0 and out[6]["n_email"] == 1
    assert out[2]["text"].endswith(".com") and len(out[2]["text"]) == len(long[1][1]) and out[2]["n_email"] == 1
    assert out[3]["n_name"] == 1 and len(out[3]["text"]) == len(long[2][1]) and out[5]["n_ip"] == 1


def test_entities_of_very_many_mentions(spark, monkeypatch):
    texts = [(i, "at 10.0.0.1 and 10.0.0.2" if i % 3 else "at 10.0.0.1") for i in range(60)]
    want = sorted(map(repr, run(spark, texts)))
    monkeypatch.setattr(pii, "HOT_MENTIONS", 50)
    assert sorted(map(repr, run(spark, texts))) == want


def test_query(spark, sf_small):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_pii_surrogates"](spark, sf_small).collect()}
    mapped = {}
    for d, t in H.documents(sf_small):
        assert shape(got[d]["text"]) == shape(t) or got[d]["n_ip"] or got[d]["n_name"]
        for e in entities(t):
            assert e not in got[d]["text"], (d, e)
        if got[d]["n_entities"] == 0:
            assert got[d]["text"] == t
        old, new = entities(t), entities(got[d]["text"])
        if len(old) == len(new):
            for a, b in zip(old, new, strict=True):
                assert mapped.setdefault(a, b) == b
    assert len(set(mapped.values())) == len(mapped) > 5


def test_edges(spark):
    out = pii.pseudonymise(H.edge_rows(spark, "gaps", "hits", "row", "entity", "kind"), "k").collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in out) == sorted(repr((d, t or "")) for d, t, *_ in H.EDGES)
    assert pii.pseudonymise(H.empty_table(spark), "k").count() == 0
