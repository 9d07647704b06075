"""A training corpus out of ``documents``: five stages, each on all that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes the session, the
documents and the folder of the tables.  All but the last return the columns of
documents:

1. toxicity: documents that the classifier rejects go;
2. line dedup: boilerplate lines of a source go from its documents;
3. n-gram Jaccard join: of each class of near duplicates (five words, similarity
   0.8) the document with the least id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: the rows of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from moodspark.llm.common import table
from moodspark.session import scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("text").isNotNull(), F.col("_kept"))
    return (line_dedup.dedup_lines(docs, "source", "text").withColumn("text", kept)
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, percent=80, width=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]
#: Models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage keeps is read several times by the next
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
