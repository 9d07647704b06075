"""Column resolution by priority (SRC4, SRC5) and the labelled-input loader.

Resolution is a pure function of ``df.columns`` evaluated on the driver; the
data work is a projection Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import labels as L
from moodspark.functions import text as T
from moodspark.operators import prep

# Candidate names in priority order (fixed values).  ``sentiment_label`` is
# appended to the label list so the cleaned-corpus layout is readable too.
TEXT_COLUMNS = ["tweet_tokens", "tweet_clean", "clean_text", "tweet", "text", "content"]
LABEL_COLUMNS = ["sentiment", "label", "target", "class", "sentiment_label"]
REPORTING_COLUMNS = ["tweet_tokens", "tweet_clean", "tweet"]


def resolve_column(columns, candidates) -> str | None:
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def resolve_text_label(df: DataFrame, text_candidates=TEXT_COLUMNS,
                       label_candidates=LABEL_COLUMNS) -> DataFrame:
    """SRC4 + PRJ1: project the first present text and label columns to
    ``(text, label)``; raise when either is missing."""
    t = resolve_column(df.columns, text_candidates)
    lab = resolve_column(df.columns, label_candidates)
    if t is None or lab is None:
        raise ValueError("input needs a text column (one of %s) and a label column (one of %s)"
                         % (", ".join(text_candidates), ", ".join(label_candidates)))
    return df.select(F.col(t).alias("text"), F.col(lab).alias("label"))


def reporting_text(df: DataFrame, order_col: str, candidates=REPORTING_COLUMNS, n: int = 1500) -> DataFrame:
    """SRC5: first present column of ``candidates``, nulls dropped, first ``n``
    rows by ``order_col`` (the cap is the feature; order is made explicit)."""
    c = resolve_column(df.columns, candidates)
    if c is None:
        raise ValueError("no reporting text column among %s" % ", ".join(candidates))
    out = df.where(F.col(c).isNotNull()).select(order_col, F.col(c).alias("text"))
    # the n ids are chosen first (short rows), so only their texts move
    ids = out.select(order_col).orderBy(order_col).limit(n).distinct()
    return out.join(ids, order_col, "left_semi").orderBy(order_col).limit(n)


def load_labelled(df: DataFrame, text_candidates=TEXT_COLUMNS, label_candidates=LABEL_COLUMNS,
                  keep: list[str] | None = None) -> DataFrame:
    """SRC4, PRJ1, FLT1, PRJ2, TXT14, FLT2: any labelled table -> (text, label int).

    Labels are normalised leniently; unmapped ones are dropped.  Text is cleaned
    and tokenised unless it already is the token column.
    """
    keep = keep or []
    t = resolve_column(df.columns, text_candidates)
    lab = resolve_column(df.columns, label_candidates)
    if t is None or lab is None:
        raise ValueError("input needs a text and a label column")
    dtype = df.schema[lab].dataType
    # TXT1: text that isn't a string cleans to nothing, and its row drops out
    base = df.where(F.col(t).isNotNull()).select(*keep, T.guard_text(df, t).alias("text"), F.col(lab).alias("label_raw")).dropna(
        subset=["text", "label_raw"])
    out = base.select(*keep, "text", L.normalise_label("label_raw", dtype).alias("label")).dropna(subset=["label"])
    if t != "tweet_tokens":
        out = out.withColumn("text", T.clean_and_tokenize(F.col("text")))
    return prep.non_empty(out, "text", strip=False)
