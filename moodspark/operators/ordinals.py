"""Row numbers of a whole table without bringing it into one task.

A table's rows are numbered within the pieces they arrive in (partitions of a
sorted table, splits of files) by ``monotonically_increasing_id``; a piece's first
number comes from the counts of the pieces before it.  Only the counts, one row a
piece, are summed up in order; the rows themselves stay where they are.

The marked rows are written to the shared folder first: an executor that is lost
and its tasks repeated can't change a number that was already counted with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.session import scratch_path

#: Pieces' first numbers are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 16 << 20


def _numbered(marked: DataFrame, piece: list[str], out: str) -> DataFrame:
    path = scratch_path(marked.sparkSession, "ordinals")
    marked.write.parquet(path)
    rows = marked.sparkSession.read.parquet(path)
    order = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    # one row a piece, whatever the number of rows
    counts = rows.groupBy(*piece).agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    size = starts.select(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in piece), F.lit(32)))).first()[0] or 0
    starts = F.broadcast(starts) if size <= BROADCAST_BYTES else starts
    return rows.join(starts, piece).withColumn(out, F.col("_before") + F.col("_mid") - F.col("_first")).drop(
        *piece, "_mid", "_first", "_before")


def number_sorted(df: DataFrame, order: list[Column], out: str = "ordinal") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order``: one range shuffle of the sort, no single task."""
    marked = df.orderBy(*order).withColumns({"_piece": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    return _numbered(marked, ["_piece"], out)


def number_input(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """A table read from files, with its rows numbered in the order of the files: by
    path, then place in the file.  ``df`` must be the scan itself or narrow steps on
    it; nothing is sorted or shuffled."""
    # a scan's splits are dealt to tasks by size, so that task order isn't input order
    marked = df.withColumns({"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                             "_mid": F.monotonically_increasing_id()})
    return _numbered(marked, ["_path", "_start"], out)
