import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodspark.llm import fill_middle as fm
from moodspark.llm import queries
from tests.llm.helpers import DOCS, duck, edge_rows, empty_table, same_as_sql

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df):
    rows = df.withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == r.text
    return rows


def as_set(text, piece):
    return fm.BoundarySet(fm.boundaries(np.frombuffer(text.encode(), np.uint8), piece))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab Z9<é日😀\n"), max_size=80), st.integers(1, 40))
def test_boundaries_are_those_of_the_pattern(text, piece):
    found = as_set(text, piece)
    ends = [0] + [m.end() for m in UNIT.finditer(text)]
    assert [found.select(k) for k in range(len(found))] == ends


@pytest.mark.parametrize("make, kinds", [
    (lambda r: "".join(r.choice("abcdefgh") * 30 + " " for _ in range(9000)), {"array"}),
    (lambda r: "".join(r.choice("ab  ") for _ in range(200_000)), {"bitmap"}),
    (lambda r: "日" * 200_000, {"run"}),
    (lambda r: "日" * 70_000 + "".join(r.choice("ab  ") for _ in range(70_000)) + "x" * 70_000, {"run", "bitmap"}),
])
def test_each_container_form_selects_right(make, kinds):
    text = make(random.Random(3))
    found = as_set(text, 1000)
    assert kinds <= {c.kind for c in found.containers}
    ends = [0] + [m.end() for m in UNIT.finditer(text)]
    assert len(found) == len(ends)
    assert [found.select(k) for k in range(0, len(ends), 97)] == ends[::97]
    assert np.concatenate([c.positions() + h * fm.SPAN for h, c in zip(found.high, found.containers)]).tolist() == ends


def test_edges_and_clashing_names(spark):
    rows = check(fm.transform(edge_rows(spark, "output", "form", "n", "_cut", "_draw")))
    assert len(rows) == 11
    assert fm.transform(empty_table(spark)).count() == 0


def test_long_texts_markers_and_meeting_signs(spark):
    rnd = random.Random(5)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(
        ["word " * 400_000, "é" * 1_500_000, "x" * 2_000_000, "a<P>b", "<M>", "<S> <S>"]
        + ["".join(rnd.choice(["<", ">", "P", "S", "M", "a", " "]) for _ in range(40)) for _ in range(200)])]
    check(fm.transform(spark.createDataFrame(rows, DOCS).repartition(4)))


def test_query_equals_its_sql(spark, sf_small):
    same_as_sql(queries.QUERIES["op11_fill_in_middle"](spark, sf_small), duck(sf_small), queries.ORACLE["op11_fill_in_middle"])
