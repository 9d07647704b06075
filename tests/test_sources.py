"""File/group sources: capped scans, CSV round trip, column resolution."""

import pytest
from pyspark.sql import functions as F

from moodspark.sources.columns import load_labelled, resolve_text_label
from moodspark.sources.files import cap_rows_per_group, read_csv, write_csv
from moodspark.session import scratch_path


def test_cap_rows_per_group_hot_group_brute_force(spark):
    # one group holds most rows; ids shuffled through a hash
    rows = [(("hot" if i % 10 else f"g{i % 7}"), (i * 7919) % 100003) for i in range(20000)]
    df = spark.createDataFrame(rows, "grp string, id long")
    got = sorted(tuple(r) for r in cap_rows_per_group(df, "grp", "id", 37, salt_buckets=8).collect())
    want = []
    by = {}
    for g, i in rows:
        by.setdefault(g, []).append(i)
    for g, ids in by.items():
        want += [(g, i) for i in sorted(ids)[:37]]
    assert got == sorted(want)


def test_csv_roundtrip_with_newlines_and_quotes(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, "NA"), (3, None)], "id long, text string")
    path = write_csv(df, scratch_path(spark, "t-csv"))
    back = {r["id"]: r["text"] for r in read_csv(spark, path, "id long, text string").collect()}
    assert back[1] == 'a "quoted"\nline'
    assert back[2] is None  # reader NA literal -> null
    assert back[3] is None


def test_resolution_priority_and_missing(spark):
    df = spark.createDataFrame([("x y z w", "hello", "Positif")], "tweet_tokens string, text string, class string")
    r = resolve_text_label(df).first()
    assert r["text"] == "x y z w" and r["label"] == "Positif"
    out = load_labelled(df).first()
    assert out["text"] == "x y z w" and out["label"] == 2  # tokens column is not re-cleaned
    with pytest.raises(ValueError):
        resolve_text_label(spark.createDataFrame([("a",)], "body string"))


def test_missing_sources_are_skipped_and_errors_are_not(spark, sf_small, tmp_path):
    from moodspark.operators import prep
    found, missing = prep.read_sources(spark, [("benchmark", f"{sf_small}/benchmark.parquet"), ("none", f"{sf_small}/nowhere.parquet")])
    assert [n for n, _ in found] == ["benchmark"] and missing == ["none"]
    bad = tmp_path / "x.parquet"
    bad.write_text("not parquet")
    with pytest.raises(Exception):
        prep.read_sources(spark, [("bad", str(bad))])[0][0][1].count()


def test_unreadable_files_of_a_glob_are_skipped(spark, tmp_path):
    from moodspark.sources.files import read_glob_capped
    (tmp_path / "a_clean.csv").write_text("id,text\n" + "".join(f"{i},t{i}\n" for i in range(50)))
    (tmp_path / "b_clean.csv.gz").write_bytes(b"\x1f\x8b not a gzip file")
    (tmp_path / "c_other.csv").write_text("id,text\n1,x\n")
    got = read_glob_capped(spark, str(tmp_path), "*_clean.csv*", 20, order="id", schema="id long, text string").collect()
    assert sorted(r["id"] for r in got) == list(range(20))


def test_batches(spark):
    from moodspark.operators import prep
    rows = [(1, "a", True), (1, None, False), (2, None, False), (3, "", True), (3, "b", True), (4, " ", True)]
    got = {r["b"]: (r["n_items"], r["n_rejected"], r["status"]) for r in prep.batch_status(
        spark.createDataFrame(rows, "b int, text string, is_item boolean"), "b").collect()}
    assert got == {1: (1, 0, "valid"), 2: (0, 0, "empty batch"), 3: (2, 1, "invalid item"), 4: (1, 0, "valid")}


def test_shared_folder_is_required_off_local(monkeypatch):
    from moodspark import session
    assert session.is_local("local[8]") and session.is_local("local")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://host:7077")

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
