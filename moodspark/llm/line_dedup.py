"""Line dedup by site-relative frequency; DataFrame functions only.

Pages are grouped by host.  For each line the pages of the host that hold it are
counted and divided by the host's pages; a line over the boilerplate ratio is
dropped from every page of that host, and stays on hosts where it is rare.

Lines are compared without the spaces around them, by a 64-bit hash within a
host; blank lines are neither counted nor dropped.

Defined results: a null or empty text has no lines and stays empty; a null host
is a host of its own; a page counts once for a line that it repeats; repeated
rows are pages each; ``min_pages`` keeps small hosts from losing everything; an
empty table gives an empty table; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.session import scratch_path

#: A line on more than this share of a host's pages is boilerplate,
MAX_RATIO = 0.05
#: if it is on so many pages at least.
MIN_PAGES = 5
#: Hosts' boilerplate is broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 16 << 20


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The hashes of a page's lines, in order; a blank line's is null."""
    return F.transform(lines(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _keys``: the hosts that have boilerplate, and its line hashes.

    Counts are summed in each task first, so a host or a line that a third of
    all pages share leaves a task as one row.  A host's keys number at most the
    mean of its pages' lines divided by ``max_ratio``.
    """
    host = F.coalesce(host.cast("string"), F.lit("")).alias("_host")
    # a page's own total counts as a line that no text can have
    keys = F.array_distinct(F.concat(F.filter(line_keys(text), lambda k: k.isNotNull()), F.array(F.lit(None).cast("long"))))
    counts = (pages.select(host, F.explode(keys).alias("_key"))
              .groupBy("_host", "_key").agg(F.count("*").alias("n")))
    totals = counts.where(F.col("_key").isNull()).select("_host", F.col("n").alias("total"))
    often = counts.where(F.col("_key").isNotNull() & (F.col("n") >= min_pages))
    return (often.join(totals, "_host").where(F.col("n") > F.col("total") * F.lit(max_ratio))
            .groupBy("_host").agg(F.collect_list("_key").alias("_keys")))


def dedup_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` with ``_kept`` (the text without boilerplate lines),
    ``_n_lines`` (lines that aren't blank) and ``_n_removed``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "boilerplate")
    boilerplate(pages, F.col(host_col), F.col(text_col), max_ratio, min_pages).write.parquet(path)
    found = spark.read.parquet(path)
    size = found.select(F.sum(F.size("_keys") * 8 + F.octet_length("_host") + 32)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    joined = (pages.withColumn("_host", F.coalesce(F.col(host_col).cast("string"), F.lit("")))
              .join(F.broadcast(found) if small else found, "_host", "left").drop("_host"))
    text = F.col(text_col)
    hits = F.array_intersect(line_keys(text), F.col("_keys"))
    kept = F.filter(lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_hits"), F.xxhash64(F.trim(x))))
    has = F.size(F.coalesce(F.col("_hits"), F.array().cast("array<bigint>"))) > 0
    return (joined.withColumn("_hits", hits).drop("_keys")
            .withColumn("_kept", F.when(has, F.array_join(kept, "\n")).otherwise(F.coalesce(text, F.lit(""))))
            .withColumn("_n_lines", F.size(F.filter(lines(text), lambda x: F.trim(x) != "")))
            .withColumn("_n_removed", F.when(has, F.size(F.filter(
                lines(text), lambda x: (F.trim(x) != "") & F.array_contains(F.col("_hits"), F.xxhash64(F.trim(x))))))
                .otherwise(F.lit(0)))
            .drop("_hits"))


ORACLE = f"""
WITH doc_lines AS (
 SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
often AS (
 SELECT host, trim(line) AS line, count(DISTINCT doc_id) AS n FROM doc_lines WHERE trim(line) <> '' GROUP BY 1, 2),
drops AS (SELECT o.host, o.line FROM often o JOIN totals t ON o.host = t.host
          WHERE o.n >= {MIN_PAGES} AND o.n > t.total * CAST({MAX_RATIO} AS DOUBLE)),
marked AS (SELECT l.*, d.line IS NOT NULL AS gone FROM doc_lines l LEFT JOIN drops d ON l.host = d.host AND trim(l.line) = d.line)
SELECT doc_id, CAST(count(*) FILTER (trim(line) <> '') AS INTEGER) AS n_lines,
       CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
