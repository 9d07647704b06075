"""Helpers shared by the operators: table access and Arrow text buffers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; a null text is empty.

    Selecting them first keeps every other column, whatever its name, out of
    the operator and out of the scan.
    """
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def rows_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``texts`` with ``row``, which tells apart texts under one id (equal rows have one ``row``)."""
    return texts(df, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_moodspark_shipped", None):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # a file of the driver's own, which Spark serves to executors; it goes when the driver ends
    folder = tempfile.mkdtemp(prefix="moodspark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "moodspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._moodspark_shipped = path


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # workers live on after a task

    return df.mapInArrow(task, schema)


#: Text of one record batch that an operator passes on.
PASSED_BYTES = 4 << 20


def kept_rows(batch: pa.RecordBatch, place: int, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows marked in ``keep``, in batches of bounded size by the text at ``place``."""
    _, offsets = utf8(batch.column(place))
    for a, b in slices(offsets, PASSED_BYTES):
        if keep[a:b].any():
            yield batch.slice(a, b - a).filter(pa.array(keep[a:b], pa.bool_()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row stands alone), so that
    the vector work on a batch needs memory in proportion to ``most``."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are both usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value, the same in every task."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses rows."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    edge[len(inside)] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
