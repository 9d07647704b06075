"""Mixing sources to target weights, by whole documents.

Words are summed by source; sources in code point order (a null one last) take the
weights in turn and share the mix by them.  No source gives more than ``MOST_TIMES``
its size: what is above is shared among the others by weight until none is above,
which is Newton's method on a concave sum and takes few rounds, each one small
aggregation in exact numbers.

A source's target over its size is its repetition rate: every document is taken
floor(rate) times, and once more where a hash of its id falls into an arc of the
unit circle as long as the rate's fraction.  So each document draws with exactly
that probability.  The arc may start at any of ``STARTS`` places; a source's start is
the one whose total comes nearest to the target, read off sums by cell of the circle,
which makes a source that a few long documents dominate come out near its target too.

Defined results: a null text has no words; a null source is a source of its own; a
source without words has target 0; equal ids of a source draw alike, and so do null
ids; repeated rows are documents each; an empty table gives an empty mix; other
columns are carried by ``mix`` and left out by ``shares``.

Sums are partial in each task first, so a hot source leaves a task as at most
2 * ``STARTS`` rows.  The plan, a row for each source, is broadcast up to
``BROADCAST_BYTES`` and joined in salted parts beyond.  Reruns agree: nothing depends
on partitions or order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import ship
from moodspark.operators.ordinals import number_sorted
from moodspark.session import scratch_path

WEIGHTS = (3, 1, 2)
#: The mix is so many half sizes of all sources together.
HALVES = 3
MOST_TIMES = 2
SEED = "mix"
STARTS = 256
BROADCAST_BYTES = 16 << 20
SALTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def source_key(source: Column) -> Column:
    """A source's key, not null; a null source differs from an empty one."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def turn(doc_id: Column, seed: str = SEED) -> Column:
    """A document's place on the circle, times ``STARTS``: 52 bits of a hash, exact as a double."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52 // STARTS))


def measured(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, key, size, turn`` of each document: texts are read here and nowhere else."""
    return _written(docs.select(
        F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        turn(F.col(id_col)).alias("turn")), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES) -> DataFrame:
    """``key, source_size, target`` of each source in ``sizes`` (``key, size``)."""
    if halves > 2 * MOST_TIMES:
        raise ValueError(f"a mix is at most {MOST_TIMES} times all sources")
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    ordered = number_sorted(sources, [F.col("key") == "n", F.col("key")], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = _written(ordered.withColumn("weight", weight.cast("long")).drop("place"), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped, open_ = None, None
    full = F.lit(False)
    while True:
        now = sources.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)),
                          F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if (now[0] or 0, now[1] or 0) == (capped, open_):
            break
        capped, open_ = now[0] or 0, now[1] or 0
        # level = share of one weight = rest / (2 * open_), compared without dividing
        rest = halves * total - 2 * MOST_TIMES * capped
        full = (F.col("source_size").cast("decimal(38,0)") * (2 * MOST_TIMES * open_)
                <= F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(20,0)"))
    share = (F.col("weight").cast("double") * float(rest)) / float(2 * open_ or 1)
    return sources.select("key", "source_size", F.when(full, (F.col("source_size") * MOST_TIMES).cast("double"))
                          .otherwise(share).alias("target"))


def _arc(rate: Column) -> list[Column]:
    """Whole copies, and the fraction's arc in steps: whole ones and the rest."""
    length = (rate - F.floor(rate)) * STARTS
    return [F.floor(rate).alias("copies"), F.floor(length).cast("int").alias("steps"), (length - F.floor(length)).alias("rest")]


def nearest_start(cells: pd.DataFrame) -> pd.DataFrame:
    """The start whose arc's sum comes nearest to what a source still lacks (at most
    2 * ``STARTS`` rows of one source)."""
    first = cells.iloc[0]
    both = np.zeros((STARTS, 2), np.int64)
    both[cells["cell"], cells["side"]] = cells["n"]
    upto = np.concatenate([[0], np.cumsum(np.tile(both.sum(1), 2))])
    start = np.arange(STARTS)
    sums = upto[start + first["steps"]] - upto[start] + both[(start + first["steps"]) % STARTS, 1]
    off = np.abs((sums + int(first["copies"]) * int(first["source_size"])).astype(float) - first["target"])
    return pd.DataFrame({"key": [first["key"]], "start": [int(off.argmin())]})


def _joined(df: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` with its source's row of ``plan`` (written before)."""
    size = plan.select(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(plan), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (df.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
            .join(plan.withColumn("_salt", salts), ["key", "_salt"]).drop("_salt"))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES) -> DataFrame:
    """A row for each source: ``key, source_size, target, copies, steps, rest, start``."""
    ship(sizes.sparkSession)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = _written(targets(sizes, weights, halves).select("*", *_arc(rate)), "mix-targets")
    cells = (_joined(sizes, sources)
             .groupBy("key", "source_size", "target", "copies", "steps", F.floor("turn").cast("int").alias("cell"),
                      (F.col("turn") - F.floor("turn") < F.col("rest")).cast("int").alias("side"))
             .agg(F.sum("size").alias("n")))
    starts = cells.groupBy("key").applyInPandas(nearest_start, "key string, start int")
    return _written(sources.join(starts, "key"), "mix-plan")


def _times() -> Column:
    """How often a document is taken; cells are whole, so this is exactly what was summed."""
    step = F.pmod(F.floor("turn").cast("int") - F.col("start"), F.lit(STARTS))
    more = (step < F.col("steps")) | ((step == F.col("steps")) & (F.col("turn") - F.floor("turn") < F.col("rest")))
    return F.col("copies").cast("long") + more.cast("long")


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, id_col: str = "doc_id",
           source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, times, taken`` of each document."""
    sizes = measured(docs, id_col, source_col, text_col)
    return (_joined(sizes, plan_mix(sizes, weights, halves)).withColumn("times", _times())
            .select("doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with ``_copy`` (1, 2, ...)."""
    plan = plan_mix(measured(docs, id_col, source_col, text_col), weights, halves)
    columns = [F.col(f"_row.{c}").alias(c) for c in docs.columns if c != "_copy"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"),
                       source_key(F.col(source_col)).alias("key"), turn(F.col(id_col)).alias("turn"))
    return (_joined(rows, plan).withColumn("_times", _times()).where("_times > 0")
            .select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")))


ORACLE = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
  ('0x' || md5('{SEED}|' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT / {2 ** 52 // STARTS}::DOUBLE AS turn FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size,
  ([{', '.join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM s GROUP BY source),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_,
  sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_ FROM t),
level AS (SELECT {HALVES} * total - {2 * MOST_TIMES} * before_ AS rest, open_ AS weights FROM r
  ORDER BY ({HALVES} * total - {2 * MOST_TIMES} * before_) / open_ DESC, open_ DESC LIMIT 1),
p AS (SELECT source, source_size, CASE WHEN source_size::HUGEINT * {2 * MOST_TIMES} * weights <= w::HUGEINT * rest THEN (source_size * {MOST_TIMES})::DOUBLE
  ELSE (w::DOUBLE * rest::DOUBLE) / (2 * weights)::DOUBLE END AS target FROM r, level),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM p),
a AS (SELECT *, floor(rate)::BIGINT AS copies, (rate - floor(rate)) * {STARTS} AS arc FROM q),
d AS (SELECT s.*, a.source_size, a.target, a.copies, floor(arc)::BIGINT AS steps, arc - floor(arc) AS rest, floor(turn)::BIGINT AS cell
  FROM s JOIN a ON s.source IS NOT DISTINCT FROM a.source),
cells AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(copies) AS copies, any_value(steps) AS steps,
  cell, turn - cell < rest AS low, sum(size)::BIGINT AS n FROM d GROUP BY source, cell, low),
tried AS (SELECT c.source, k.k, abs((any_value(copies) * any_value(source_size) + coalesce(sum(n) FILTER (
   (cell - k + {STARTS}) % {STARTS} < steps OR ((cell - k + {STARTS}) % {STARTS} = steps AND low)), 0))::DOUBLE - any_value(target)) AS off
  FROM cells c, (SELECT unnest(range({STARTS})) AS k) k GROUP BY c.source, k.k),
chosen AS (SELECT source, arg_min(k, (off, k)) AS k FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN (cell - k + {STARTS}) % {STARTS} < steps
  OR ((cell - k + {STARTS}) % {STARTS} = steps AND turn - cell < rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN chosen ON d.source IS NOT DISTINCT FROM chosen.source
"""
