"""Connected components of a large graph by alternating stars.

Each round hangs every node's larger neighbours on its least one (large star),
then its smaller neighbours (small star), until nothing changes; the number of
rounds grows with the logarithm of the graph's size.  Rounds are aggregations
and joins on short rows, and each is checkpointed, so neither the links nor the
components ever meet in one place.

A graph of at most ``ONE_TASK`` links (16 bytes each) is one task's instead: there rounds
would be many jobs of next to nothing.  The classes are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import map_arrow
from moodspark.session import reliable_checkpoint

MOST_ROUNDS = 64
ONE_TASK = 1 << 18
NODES = "node long, component long"


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _in_one_task(e: DataFrame) -> DataFrame:
    """Union-find; a class's head is always its least node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def head(x: int) -> int:
            at = x
            while up.setdefault(at, at) != at:
                at = up[at]
            while up[x] != at:
                up[x], x = at, up[x]
            return at

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = head(a), head(b)
                up[max(x, y)] = min(x, y)
        nodes = sorted(x for x in up if head(x) != x)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([head(x) for x in nodes], pa.int64())],
                                         ["node", "component"])

    return reliable_checkpoint(map_arrow(e.select("a", "b").repartition(1), run, NODES))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of the nodes of ``links`` (``a, b``, numbers)
    that aren't their component's least; links of a node to itself count for nothing."""
    e = reliable_checkpoint(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= ONE_TASK:
        return _in_one_task(e)
    seen = None
    for _ in range(MOST_ROUNDS):
        # a sum of hashes tells one set of links from another
        said = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == seen or not said[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = said
        e = reliable_checkpoint(_small(_large(e)))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
