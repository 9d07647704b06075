"""Each stage on its input against brute force, and the guard around the subpackage."""

import os
import subprocess
import sys

import duckdb
import public_tokenizers
import tokenizers

import corpus_pipeline
from moodspark.llm import line_dedup, toxicity
from moodspark.session import scratch_path
from tests.llm import helpers as H
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_packing import check

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_small)
        if name != "best-fit packing":
            assert out.columns == COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.read.parquet(f"{sf_small}/documents.parquet"), model).collect()}
            assert kept == {d for d in before if scores[d] < 0.5}
            assert all(r == before[r["doc_id"]] for r in after)
        elif name == "line dedup":
            want = lines([(d, r["text"], r["source"]) for d, r in before.items()], line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((d, t) for d, t, *_ in want)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, _, c in classes([(d, r["text"]) for d, r in sorted(before.items())], 80, 5)}
        elif name == "benchmark decontamination":
            items = duckdb.sql(f"SELECT item_id, text FROM '{sf_small}/benchmark.parquet'").fetchall()
            assert kept == before.keys() - {d for d, _ in leaks([(d, r["text"]) for d, r in before.items()], items)}
        else:
            check(after, [(d, r["text"]) for d, r in before.items()], tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_run_equals_stages(spark, sf_small):
    a = corpus_pipeline.run(spark, sf_small)
    assert a.count() > 0 and "sequence_id" in a.columns


def test_stages_on_odd_rows(spark, sf_small):
    docs = H.edge_rows(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small)
        assert docs.columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() > 0
    empty = H.empty_table(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).count() == 0


def test_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "moodspark.llm" or name.startswith("moodspark.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries() and len(e.oracle_sql()) > 60
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
