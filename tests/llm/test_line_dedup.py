from collections import Counter

from moodspark.llm import line_dedup, queries
from tests.llm import helpers as H


def test_query_equals_sql(spark, sf_small):
    H.same_as_sql(queries.QUERIES["op1_line_dedup"](spark, sf_small), H.duck(sf_small), queries.ORACLE["op1_line_dedup"])


def brute(rows, ratio, least):
    pages, held = Counter(), Counter()
    for _, text, host in rows:
        pages[host or ""] += 1
        held.update({(host or "", x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for doc, text, host in rows:
        drop = lambda x: x.strip(" ") and held[host or "", x.strip(" ")] >= least and held[host or "", x.strip(" ")] > ratio * pages[host or ""]
        lines = (text or "").split("\n")
        out.append((doc, "\n".join(x for x in lines if not drop(x)), sum(bool(x.strip(" ")) for x in lines), sum(bool(drop(x)) for x in lines)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    """A host with most pages, a line that only one host repeats, a line under the ratio, ties with it."""
    rows = [(i, f"menu\nunique {i}\n" + ("footer \n" if i % 3 else "") + ("rare" if i < 4 else ""), "hot" if i % 4 else f"h{i % 8}")
            for i in range(80)]
    rows += [(100, None, "hot"), (101, "", None), (102, "\n \n", "hot"), (103, "menu", None), (5, "menu\nmenu\nx", "hot"), (5, "menu\nmenu\nx", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string").repartition(4)
    for ratio, least in ((0.05, 5), (0.66, 2), (0.0, 1), (1.0, 1)):
        got = line_dedup.dedup_lines(df, "site", "text", ratio, least).select("doc_id", "_kept", "_n_lines", "_n_removed")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, ratio, least)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    df = H.edge_rows(spark)
    want = sorted(map(repr, line_dedup.dedup_lines(df, max_ratio=0.0, min_pages=1).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, line_dedup.dedup_lines(df, max_ratio=0.0, min_pages=1).collect())) == want


def test_edges(spark):
    df = H.edge_rows(spark, "n", "total", "line", "kept")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "_kept", "_n_lines", "_n_removed"] and out.count() == len(H.EDGES)
    assert line_dedup.dedup_lines(H.empty_table(spark)).count() == 0
