import hashlib
import re

from moodspark.llm import queries, secret_scan
from tests.llm import helpers as H


def test_query_equals_sql(spark, sf_small):
    H.same_as_sql(queries.QUERIES["op4_secret_scans"](spark, sf_small), H.duck(sf_small), queries.ORACLE["op4_secret_scans"])


def base_spans(text):
    """The stated patterns, plainly, with Python's expressions."""
    found = []
    for no, (kind, pattern, group, least) in enumerate((
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        found += [(m.start(), no, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return [s for *_, s in sorted(found)]


HEX = "0123456789abcdef" * 3
ROWS = [
    (1, f'token = "{HEX}"', "en", "a"), (2, f"x password: {HEX} AKIA{'Z9' * 9} é", "en", "a"), (3, "password: token: abcdefgh", "en", "b"),
    (4, "PassWord='s3cr3t+/==' api_key=abcde api-key:longvalue APIKEY :  val.ue-1", "en", "b"),
    (5, "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 20, "de", "c"), (6, f"😀 {HEX[:24]} {HEX[:23]}", "de", "c"), (7, None, None, None), (8, "", "en", "a"),
    (9, "secret=" + "Ab1" * 10 + " and " + "Xy9_" * 8, "en", "a"), (9, "secret=" + "Ab1" * 10 + " and " + "Xy9_" * 8, "en", "a"),
    (10, "copied " + "Qq7-" * 8, "en", "s1"), (11, "copied " + "Qq7-" * 8, "en", "s2"), (12, "copied " + "Qq7-" * 8, "en", "s3"),
    (13, f"toKen = {HEX}", "en", "s3"), (None, "token=" + "q" * 9, "en", "a"),
]


def test_base_spans_by_hand_patterns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    got = secret_scan.scan_secrets(df).collect()
    want = {}
    for d, t, *_ in ROWS:
        want[d] = base_spans(t)
    assert len(got) == len(ROWS)
    for r in got:
        base = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (r, base)
        assert set(base) <= set(r["spans"].split(",")) | set() if base else True
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_ownership_tells_copies_from_live_values(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    assert "opaque" in got[9]["spans"] and got[9]["n_live"] >= 2        # one owner holds it, in two rows
    assert got[10]["spans"] == "" == got[12]["spans"]                    # three owners: an example
    assert "opaque" in {r["doc_id"]: r for r in secret_scan.scan_secrets(df, live_owners=3).collect()}[10]["spans"]
    # the hexadecimal value has three owners (a, b is not one): base span stays, as an example
    assert got[13]["n_hex"] == 1


def test_repositories_alone_tell_a_copy(spark):
    """One owner each; only the number of repositories differs."""
    few, many = "Zz9-" * 8, "Yy8_" * 8
    rows = [(i, f"x {few}", f"r{i % 4}", "one") for i in range(8)] + [(100 + i, f"x {many}", f"r{i % 5}", "two") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["doc_id"]: r["n_live"] for r in secret_scan.scan_secrets(df).collect()}
    assert all(got[i] == 1 for i in range(8)) and all(got[100 + i] == 0 for i in range(8))
    assert {r["n_live"] for r in secret_scan.scan_secrets(df, live_repositories=5).collect()} == {1}


def test_many_spans_long_texts_and_hot_values(spark, monkeypatch):
    hexes = " ".join(f"{i:024x}" for i in range(60_000))
    rows = [(1, hexes, "en", "a"), (2, "token=" + "a" * 1_500_000, "en", "a"), (3, "token:" * 300_000, "en", "b"), (4, "deadbeef" * 4, "en", "c"),
            (5, "deadbeef" * 4, "en", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = {d: base_spans(t) for d, t, *_ in rows}
    for hot in (1_000_000, 1):
        monkeypatch.setattr(secret_scan, "HOT_ROWS", hot)
        for r in secret_scan.scan_secrets(df).collect():
            base = want[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert r["n_hex"] == sum(s.startswith("hex") for s in base)


def test_edges(spark):
    out = secret_scan.scan_secrets(H.edge_rows(spark, "row", "owner", "found", "start", "parts")).collect()
    assert len(out) == len(H.EDGES)
    assert secret_scan.scan_secrets(H.empty_table(spark)).count() == 0
