"""Batch scoring (SCO1-SCO4): text -> label, confidence, tokens.

A fitted :class:`~pyspark.ml.PipelineModel` (feature chain + classifier) is
applied with one distributed ``transform``: every stage is row-local, so
scoring itself never shuffles.  The input order is carried by an ordinal column,
given or derived from the files, rather than by partition order; only a sort that the
caller asks for by a given ordinal is a shuffle.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions import labels as L
from moodspark.functions import scores as SC
from moodspark.functions import text as T
from moodspark.operators.ordinals import number_input

EMPTY_LABEL = "neutral"
EMPTY_SCORE = 0.0


def apply_empty_rule(df: DataFrame, tokens_col: str, label: Column, score: Column) -> DataFrame:
    """SCO2: no tokens -> ``neutral``, 0.0, ``""``; otherwise the model's answer."""
    empty = F.coalesce(F.col(tokens_col), F.lit("")) == ""
    return df.select("*",
                     F.when(empty, F.lit(EMPTY_LABEL)).otherwise(label).alias("label"),
                     F.when(empty, F.lit(EMPTY_SCORE)).otherwise(score).alias("score"))


def score(model: PipelineModel, df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
          tokens_col: str = "tokens") -> DataFrame:
    """SCO1-SCO3: ``keep`` columns + label, score, tokens for every input row.

    The model's first stage reads ``tokens`` (an array); texts that clean to
    nothing bypass the classifier result per SCO2.
    """
    keep = keep or []
    prepared = df.select(*keep, T.tokenize(F.col(text_col)).alias(tokens_col))
    out = model.transform(prepared)
    cols = set(out.columns)
    pred = F.col("prediction").cast("int")
    raw = vector_to_array(F.col("rawPrediction")) if "rawPrediction" in cols else None
    prob = vector_to_array(F.col("probability")) if "probability" in cols else None
    if prob is not None:
        conf = F.element_at(prob, pred + 1)
    elif raw is not None:
        conf = SC.confidence(raw, pred)
    else:
        conf = F.lit(0.0)
    tok_str = F.array_join(F.col(tokens_col), " ")
    res = out.select(*keep, tok_str.alias("tokens"), L.label_name(pred).alias("_label"), conf.alias("_score"))
    empty = F.col("tokens") == ""
    return res.select(*keep,
                      F.when(empty, F.lit(EMPTY_LABEL)).otherwise(F.col("_label")).alias("label"),
                      F.when(empty, F.lit(EMPTY_SCORE)).otherwise(F.col("_score")).alias("score"),
                      "tokens")


def score_batch(model: PipelineModel, df: DataFrame, text_col: str = "text",
                ordinal_col: str | None = "ordinal") -> DataFrame:
    """SCO4: same rows out as in, with the ordinal that tells their order.

    A table with an ordinal is sorted by it.  With ``ordinal_col=None`` the table must be
    a scan of files: rows are numbered in the order of the files from counts by split,
    nothing is sorted, and ``write_in_order`` keeps the order on disk.
    """
    if ordinal_col is not None:
        return score(model, df, text_col, keep=[ordinal_col]).orderBy(ordinal_col)
    return score(model, number_input(df, "ordinal"), text_col, keep=["ordinal"])


#: Rows of one file of an ordered output.
FILE_ROWS = 1_000_000


def write_in_order(df: DataFrame, path: str, ordinal_col: str = "ordinal", rows: int = FILE_ROWS) -> str:
    """Writes folders ``part=0, 1, ...`` of ``rows`` ordinals each, rows in order within
    each file.  Tasks sort what they hold and write it where it belongs; no row is
    shuffled, so a folder has a file for each task that held some of it."""
    (df.withColumn("part", F.floor(F.col(ordinal_col) / rows)).sortWithinPartitions("part", ordinal_col)
     .write.partitionBy("part").parquet(path))
    return path
