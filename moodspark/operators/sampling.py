"""Reproducible stratified sampling, splitting and folds (SMP1-SMP4).

Every row gets a seeded hash key ``md5('<seed>|<id>')`` and an exact rank ``r``
within its class by that key (ties by id), i.e. ``row_number() over
(partition by label order by key, id)``.  Computing that window directly puts a
whole class in one task, and one class may hold a third of all rows, so the
rank is assembled from two bounded pieces instead:

* the first ``bucket_digits`` hex digits of the key split each class into
  ``16**bucket_digits`` buckets of near-equal size (md5 is uniform);
* a histogram ``(label, bucket) -> count`` (map-side partially aggregated, at
  most ``classes x 16**digits`` rows) gives each bucket's offset in its class;
* ``row_number`` runs per (label, bucket) - many small groups - and is added to
  the offset.  The join on (label, bucket) reuses the window's partitioning.

The result equals the global window exactly (checked against SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def hash_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def class_rank(df: DataFrame, label: str, id_col: str, seed: int = DEFAULT_SEED,
               bucket_digits: int = 4) -> DataFrame:
    """Add ``_key``, ``rank`` (1-based, long) and ``class_n`` (rows in the class)."""
    d = df.withColumn("_key", hash_key(id_col, seed)).withColumn(
        "_bucket", F.conv(F.substring("_key", 1, bucket_digits), 16, 10).cast("int"))
    hist = d.groupBy(label, "_bucket").agg(F.count("*").alias("_bn"))
    by_class = Window.partitionBy(label)
    before = by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(label, "_bucket",
                          F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                          F.sum("_bn").over(by_class).alias("class_n"))
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_key", id_col)
    ranked = d.withColumn("_rin", F.row_number().over(in_bucket))
    out = ranked.join(offsets, [label, "_bucket"])
    return out.withColumn("rank", (F.col("_off") + F.col("_rin")).cast("long")).drop(
        "_bucket", "_rin", "_off")


def stratified_cap(df: DataFrame, label: str, id_col: str, n: int | None,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP1: per class the ``min(n_c, n)`` rows with the smallest hash keys.

    ``n`` of 0/None means no cap (the input is returned unchanged).
    """
    if not n:
        return df
    r = class_rank(df, label, id_col, seed)
    return r.where(F.col("rank") <= n).drop("_key", "rank", "class_n")


def split_column(rank="rank", n="class_n") -> Column:
    """SMP3 rule: train ``10r <= 7n``, val ``20r <= 17n``, else test."""
    r, c = F.col(rank), F.col(n)
    return (F.when(r * 10 <= c * 7, F.lit("train"))
            .when(r * 20 <= c * 17, F.lit("val"))
            .otherwise(F.lit("test")))


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = DEFAULT_SEED,
                     cap: int | None = None, sample_first: bool = False) -> DataFrame:
    """SMP3: add ``split`` in {train, val, test}, exact 70 / 15 / 15 per class.

    ``cap`` bounds the rows to fit on: of each class's train rows those of the
    lowest ranks are kept, and all val and test rows.  With ``sample_first``
    (SMP1, then SMP3, the reference's order) the ``cap`` lowest-ranked rows of
    each class are split and no others are kept.  Ranks are the same, so cap
    and split share one ranking pass.
    """
    r = class_rank(df, label, id_col, seed)
    if cap and sample_first:
        r = r.where(F.col("rank") <= cap).withColumn("class_n", F.least(F.col("class_n"), F.lit(cap)))
    r = r.withColumn("split", split_column())
    if cap and not sample_first:
        r = r.where((F.col("split") != "train") | (F.col("rank") <= cap))
    return r.drop("_key", "rank", "class_n")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP4: add ``fold`` = (rank - 1) mod k within each class (int)."""
    r = class_rank(df, label, id_col, seed)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("_key", "rank", "class_n")


def shuffled(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP2: a seeded full permutation (range-partitioned global sort by hash key)."""
    return df.withColumn("_key", hash_key(id_col, seed)).orderBy("_key", id_col).drop("_key")
