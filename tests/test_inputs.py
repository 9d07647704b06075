"""SRC1, SRC3, SCO4 and SNK5: splits of quoted files, heads, input order, versions."""

import csv
import io
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from moodspark.operators import ordinals
from moodspark.plans import scoring, training
from moodspark.session import scratch_path
from moodspark.sources import csv_head, csv_ranges
from moodspark.sources.files import CSV_OPTIONS, read_csv, read_glob_capped


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted_file(path, n=400, seed=0, end="\n"):
    rnd = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "text", "more"])
        for i in range(n):
            text = rnd.choice(["plain", 'say "hi"', "two\nlines", '"', '""\n"', "a,b", "", "é\r\nx", "\n\n", "long " * 300 + '\n"q"', " pad "])
            w.writerow([i, text, rnd.choice(["", "x", 'y"\nz', "None"])])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_is_split_and_equals_the_multi_line_reader(spark, tmp_path, small_splits, end):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        quoted_file(folder / f"{k}.csv", seed=k, end=end)
    schema = "id long, text string, more string"
    want = spark.read.options(**CSV_OPTIONS).schema(schema).csv(str(folder)).collect()
    got = csv_ranges.read(spark, str(folder), spark.read.schema(schema).csv(str(folder)).schema,
                          options={k: v for k, v in CSV_OPTIONS.items() if k != "header"})
    rows = got.collect()
    with open(folder / "0.csv", newline="", encoding="utf-8") as f:
        plain = [(int(i), t or None, m or None) for i, t, m in list(csv.reader(f))[1:]]
    assert set(plain) <= set(map(tuple, rows))
    if end != "\n":  # Spark's reader makes such a file's inner line ends plain ones; here they stay
        rows = [r.__class__(*(v.replace(end, "\n") if isinstance(v, str) else v for v in r)) for r in rows]
        want = [r.__class__(*r) for r in want]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, want))) and len(want) == 1200
    lines = csv_ranges._lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 50
    whole = read_csv(spark, str(folder), schema).collect()
    assert len(whole) == 1200 and {r.more for r in whole} >= {None, "x", 'y"\nz'}


def test_splits_inside_one_field_and_the_shuffled_way(spark, tmp_path, small_splits, monkeypatch):
    p = tmp_path / "one.csv"
    with open(p, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text"], [1, "line\n" * 2000], [2, "short"], [3, 'q"\n' * 900], [4, "end"]])
    schema = spark.read.schema("id long, text string").csv(str(p)).schema
    for limit in (16 << 20, -1):
        monkeypatch.setattr(csv_ranges, "BROADCAST_BYTES", limit)
        got = {r.id: r.text for r in csv_ranges.read(spark, str(p), schema, options={"escape": '"', "multiLine": "true"}).collect()}
        assert got == {1: "line\n" * 2000, 2: "short", 3: 'q"\n' * 900, 4: "end"}


def test_empty_and_headless_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text('1,"x\ny"\n2,z')
    schema = spark.read.schema("id long, text string").csv(str(tmp_path)).schema
    assert sorted(map(tuple, csv_ranges.read(spark, str(tmp_path), schema, header=False, options={"multiLine": "true"}).collect())) == [
        (1, "x\ny"), (2, "z")]


class Counting(io.RawIOBase):
    """An endless file that counts what is read of it."""

    def __init__(self):
        self.read_bytes, self.line = 0, b'1,"two\nlines"\n'

    def readable(self):
        return True

    def readinto(self, b):
        got = (self.line * (len(b) // len(self.line) + 2))[self.read_bytes % len(self.line):][:len(b)]
        b[:len(got)] = got
        self.read_bytes += len(got)
        return len(got)


def test_a_head_reads_no_more_than_it_needs():
    raw = Counting()
    rows = list(csv_head.head_records(raw, 1500, False))
    assert rows == [["1", "two\nlines"]] * 1500
    assert raw.read_bytes <= 1500 * len(raw.line) + 2 * csv_head.BUFFER_BYTES


def test_heads_of_matching_files(spark, tmp_path):
    for k in range(4):
        quoted_file(tmp_path / f"s{k}_clean.csv", n=20 * k, seed=k)
    quoted_file(tmp_path / "other.csv", n=9)
    (tmp_path / "bad_clean.csv").write_bytes(b"id,text,more\n\xff\xfe\xff,x,y\n")
    got = read_glob_capped(spark, str(tmp_path), cap=30)
    assert got.columns == ["id", "text", "more", "_file"]
    counts = {os.path.basename(r._file): r["count"] for r in got.groupBy("_file").count().collect()}
    assert counts == {"s1_clean.csv": 20, "s2_clean.csv": 30, "s3_clean.csv": 30}
    assert [r.id for r in got.where(F.col("_file").endswith("s3_clean.csv")).collect()] == [str(i) for i in range(30)]
    with pytest.raises(ValueError):
        read_glob_capped(spark, str(tmp_path), "none*.csv")


def test_rows_are_numbered_in_input_order_without_a_sort(spark, tmp_path, small_splits):
    for k, n in enumerate((700, 1, 300)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k} {i} {'x' * (i % 50)}\n" for i in range(n)))
    df = spark.read.text(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    got = ordinals.number_input(df.where("value <> ''"))
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()
    want = [line for k in range(3) for line in (tmp_path / f"part-{k}.txt").read_text().splitlines()]
    assert [r.value for r in sorted(got.collect(), key=lambda r: r.ordinal)] == want
    assert sorted(r.ordinal for r in got.collect()) == list(range(1001))
    out = scoring.write_in_order(got, scratch_path(spark, "ordered"), rows=100)
    back = spark.read.parquet(out)
    assert back.select("part").distinct().count() == 11
    for part in (0, 7):
        assert sorted(r.ordinal for r in back.where(F.col("part") == part).collect()) == list(range(100 * part, 100 * part + 100))


def test_sorted_rows_are_numbered_whatever_the_partitions(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(5000), 3000)] + [(None,)], "x long").repartition(13)
    rows = ordinals.number_sorted(df, [F.col("x").asc_nulls_last()]).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.ordinal)] == sorted(r.x for r in rows if r.x is not None) + [None]
    assert sorted(r.ordinal for r in rows) == list(range(3001))
    assert ordinals.number_sorted(df.limit(0), [F.col("x")]).count() == 0


def test_scoring_a_file_keeps_its_order(spark, tmp_path, small_splits):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, cast(size(tokens) % 3 AS double) AS prediction FROM __THIS__")])
    texts = [f"{'great ' * (i % 5)}word {i}" for i in range(600)]
    (tmp_path / "in.txt").write_text("\n".join(texts))
    out = scoring.score_batch(model, spark.read.text(str(tmp_path)), "value", None)
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    rows = sorted(out.collect(), key=lambda r: r.ordinal)
    assert [len(r.tokens.split()) for r in rows] == [i % 5 + 1 for i in range(600)]


def test_twenty_writers_get_versions_one_to_twenty(spark):
    reg = scratch_path(spark, "many-writers")
    with ThreadPoolExecutor(20) as pool:
        got = list(pool.map(lambda i: training.register(spark, reg, "m/é", f"path-{i}", {"f1": i / 20}, {"i": i}), range(20)))
    assert sorted(got) == list(range(1, 21))
    rows = spark.read.schema(training.REGISTRY_SCHEMA).parquet(reg).collect()
    assert {(r.version, r.path, r.metrics["f1"], r.params["i"]) for r in rows} == {
        (v, f"path-{i}", i / 20, str(i)) for i, v in enumerate(got)}
    assert all(r.ts is not None and r.name == "m/é" for r in rows)
    assert training.register(spark, reg, "m", "p", {}) == 1


def test_publishing_by_rename_does_not_overwrite(spark):
    """The way of file systems that aren't local."""
    from moodspark.sources.commit_log import CommitLog

    log = CommitLog(spark, scratch_path(spark, "renamed"))
    log.local = None
    assert [log.append("m", lambda v: b"x" * v) for _ in range(3)] == [1, 2, 3]
    out = log.fs.create(log._child(".own"), False)
    out.close()
    assert not log._publish(".own", "m.v000000000002.parquet")
    assert log.versions("m") == [1, 2, 3]
