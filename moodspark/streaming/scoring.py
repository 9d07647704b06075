"""Continuous scoring with Structured Streaming (SCO5).

Texts arriving as files are scored by the same fitted pipeline as the batch
path.  Every stage is row-local, so the query is stateless: no watermark, no
state store.  The sink is ``foreachBatch`` writing each micro-batch to its own
``batch_id=<n>`` partition with ``overwrite`` of that partition only, which
makes a replayed batch (after a driver or executor failure) idempotent; the
checkpoint lives in the shared folder, so a restarted query resumes where it
stopped.  ``foreachBatch`` also lets models whose Python ``transform`` is not
stream-capable (one-vs-rest) score every micro-batch as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodspark.plans.scoring import score
from moodspark.session import scratch_path


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType,
                 text_col: str, keep: list[str], sink_dir: str | None = None,
                 checkpoint_dir: str | None = None, max_files_per_trigger: int | None = None,
                 available_now: bool = True, glob: str | None = None):
    """Start the scoring query; returns (StreamingQuery, sink_dir).  ``glob`` names files,
    or folders of files, in ``source_dir``."""
    sink_dir = sink_dir or scratch_path(spark, "stream-sink")
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "stream-ckpt")
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern of paths finds a table that is a folder, too; braces make a plain name a pattern
    src = r.parquet(f"{source_dir.rstrip('/')}/{{{glob}}}" if glob else source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = score(model, batch, text_col, keep=keep).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start(), sink_dir
