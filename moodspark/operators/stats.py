"""Corpus statistics (AGG1-AGG7).

All aggregations are ``groupBy`` with map-side partial aggregation, so a label
or source holding a third of the rows is pre-reduced in every task before the
shuffle.  Windows without a partition only ever run over the few aggregated
rows (one per label/source, or the k words kept).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from moodspark.functions.labels import LABEL_NAMES
from moodspark.session import reliable_checkpoint


def _all():
    return Window.partitionBy()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG1: rows per value, most frequent first (ties by value)."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG2: rows per value ordered by the value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def class_share(df: DataFrame, col: str) -> DataFrame:
    """AGG3: count and percentage of the total."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(_all()))


def dataset_profile(df: DataFrame, source: str, label: str) -> DataFrame:
    """AGG4: per source, tweets and % negative / neutral / positive (absent -> 0)."""
    piv = (df.groupBy(source).pivot(label, LABEL_NAMES).agg(F.count(F.lit(1)))
           .na.fill(0, LABEL_NAMES))
    tweets = sum(F.col(n) for n in LABEL_NAMES)
    out = piv.select(source, tweets.cast("long").alias("tweets"),
                     *[F.col(n).cast("long").alias(f"n_{n}") for n in LABEL_NAMES])
    out = out.where(F.col("tweets") > 0)
    return out.select("*", *[(F.col(f"n_{n}") * 100.0 / F.col("tweets")).alias(f"pct_{n}") for n in LABEL_NAMES])


def dataset_share(df: DataFrame, source: str) -> DataFrame:
    """AGG5: tweets per source, grand total and share (1 dp)."""
    counts = df.groupBy(source).agg(F.count("*").alias("tweets"))
    total = F.sum("tweets").over(_all())
    return counts.select(source, "tweets", total.alias("total"),
                         F.round(F.col("tweets") * 100.0 / total, 1).alias("share_pct"))


#: Words a sketch follows; partial sketches are merged in so many groups first.
TRACKED, SKETCH_GROUPS = 16_384, 256


def frequent(words: DataFrame, col: str, k: int, tracked: int = TRACKED) -> tuple[DataFrame, bool]:
    """``col, n`` of the ``k`` most frequent values, ties by value, and whether the sketch
    sufficed; exact either way.

    A frequent-items sketch of each task, merged in groups, names at most ``tracked``
    candidates, and a second pass counts those alone: what is shuffled depends on tasks
    and ``tracked``, not on how many values there are.  The sketch's error is at most
    2.625 / tracked of all rows (3.5 over its map's size, which is a third larger), it
    may leave out what counts up to twice that, and of those it holds only the first
    ``tracked`` are asked for: a value that is no candidate counts at most
    6.25 / tracked of all rows.  If the ``k``-th exact count is above that, the result is
    proven; else all values are counted.
    """
    parts = reliable_checkpoint(words.select(F.col(col).cast("string").alias("w"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
             .where("w IS NOT NULL").groupBy("g").agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"), F.count("*").alias("n")))
    if parts.isEmpty():
        return words.select(F.col(col).cast("string").alias(col), F.lit(0).cast("long").alias("n")).limit(0), True
    merged = parts.agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    found = merged.select("n", F.expr(f"approx_top_k_estimate(s, {tracked}).item").alias("w")).first()
    some = words.sparkSession.createDataFrame([(w,) for w in found["w"]], f"`{col}` string")  # at most ``tracked``
    exact = words.join(F.broadcast(some), col, "left_semi").groupBy(col).agg(F.count("*").alias("n"))
    top = exact.orderBy(F.desc("n"), F.asc(col)).limit(k).collect()  # k rows
    if len(found["w"]) < tracked and len(top) == len(found["w"]) < k:
        least = -1 if found["n"] == sum(r["n"] for r in top) else 0  # every value was counted
    else:
        least = top[-1]["n"] if len(top) == k else 0
    if least == -1 or least > 6.25 * found["n"] / tracked:
        return words.sparkSession.createDataFrame([(r[col], r["n"]) for r in top], f"`{col}` string, n long"), True
    counts = words.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k), False


def word_frequencies(df: DataFrame, tokens_col: str, k: int = 120, tracked: int | None = None) -> DataFrame:
    """AGG6: the ``k`` most frequent single words with relative frequency.

    explode -> partial count per task -> shuffle on word -> top-k
    (TakeOrderedAndProject keeps k rows per task) -> ratio to the top count.  With
    ``tracked`` the words come from :func:`frequent`, whose shuffle doesn't grow with the
    vocabulary, for a second pass over the texts.
    """
    # explode_outer + null filter: a plain explode makes the optimizer push a
    # size(tokens) > 0 filter below the projection, evaluating the whole
    # cleaning chain twice per document
    words = df.select(F.explode_outer(F.col(tokens_col)).alias("word")).where(F.col("word").isNotNull())
    if tracked:
        top = frequent(words, "word", k, tracked)[0]
    else:
        top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("word")).limit(k)
    return top.select("word", "n", (F.col("n") / F.max("n").over(_all())).alias("rel_freq"))


def deduplicated_funnel(df: DataFrame, key: str, order: list[str], stages: list[tuple[str, object]]) -> DataFrame:
    """AGG7 with de-duplication first, in one shuffle of short rows.

    Each row's predicates are evaluated where it is read; a task reduces the
    rows of one text to the first of them by ``order`` with its flags, and only
    the text's digest, the order and the flags cross the shuffle.
    """
    digest = F.unhex(F.sha2(F.col(key).cast("string"), 256))
    flags = df.select(digest.alias("_d"), *order, *[p.alias(f"_f_{n}") for n, p in stages])
    first = F.min(F.struct(*order, *[f"_f_{n}" for n, _ in stages])).alias("_k")
    kept = flags.groupBy("_d").agg(F.count("*").alias("_n"), first)
    aggs, acc = [F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_input"), F.count("*").alias("n_deduplicated")], F.lit(True)
    for name, _ in stages:
        acc = acc & F.coalesce(F.col(f"_k._f_{name}"), F.lit(False))
        aggs.append(F.count_if(acc).alias(f"n_{name}"))
    return kept.agg(*aggs)


def funnel_counts(df: DataFrame, stages: list[tuple[str, object]]) -> DataFrame:
    """AGG7: rows surviving each cumulative stage, in one pass.

    ``stages`` holds (name, boolean Column) pairs; stage k counts rows passing
    the first k predicates.
    """
    aggs, acc = [F.count("*").alias("n_input")], None
    for name, pred in stages:
        acc = pred if acc is None else (acc & pred)
        aggs.append(F.sum(F.when(acc, 1).otherwise(0)).cast("long").alias(f"n_{name}"))
    return df.agg(*aggs)


def write_with_funnel(df: DataFrame, key: str, order: list[str], stages: list[tuple[str, object]], write) -> dict[str, int]:
    """AGG7 while the corpus is written: the rows that pass de-duplication and all stages
    go to ``write(rows)``, and the counts of each step are observed in that same job.
    (A task that runs twice may count twice; the rows written are right in any case.)"""
    spark = df.sparkSession
    # observed in a session of its own: one that has observed can't be sent to tasks any
    # more, which some of Spark's models do (OneVsRest)
    view = f"funnel_{uuid.uuid4().hex}"
    df.createGlobalTempView(view)
    try:
        rows = spark.newSession().table(f"global_temp.{view}")
        seen = {name: Observation(f"funnel-{name}") for name in ["input", "deduplicated", *[n for n, _ in stages]]}
        digest = F.unhex(F.sha2(F.col(key).cast("string"), 256))
        id_col = order[-1]
        keepers = rows.groupBy(digest.alias("_d")).agg(F.min(F.struct(*order)).alias("_k")).select(F.col(f"_k.{id_col}").alias(id_col))
        rows = rows.observe(seen["input"], F.count(F.lit(1)).alias("n")).join(keepers, id_col, "left_semi")
        rows = rows.observe(seen["deduplicated"], F.count(F.lit(1)).alias("n"))
        for name, predicate in stages:
            rows = rows.where(predicate).observe(seen[name], F.count(F.lit(1)).alias("n"))
        write(rows)
    finally:
        spark.catalog.dropGlobalTempView(view)
    return {f"n_{name}": int(o.get["n"]) for name, o in seen.items()}
