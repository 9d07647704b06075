"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

# Conservative defaults for a local run; on a cluster the submitter's settings win
# because ``getOrCreate`` returns the already configured session.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is known to be small; everything else sort-merges.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Local runs: the driver is the executor; iterative ML creates one small
    # broadcast per optimiser iteration, released by the context cleaner on GC.
    "spark.driver.memory": "8g",
    "spark.cleaner.periodicGC.interval": "2min",
    # checkpoint files of RDDs that went out of scope are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "moodspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        # one executor: there is no locality to wait for, and iterative ML runs
        # concurrent one-task jobs that would otherwise idle in the scheduler.
        # Clusters keep the default so cached blocks are read where they live.
        conf["spark.locality.wait"] = "0"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Return the cluster-wide folder named by ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a ``local`` master (driver and
    executor are one process) may leave it unset: then a fresh folder is made
    once per context and removed when the process ends.  On any other master a
    machine-local folder would be lost with its machine, so this raises.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = getattr(sc, "_moodspark_shared_dir", None)
    if not d:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="moodspark-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc._moodspark_shared_dir = d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def is_local(master: str) -> bool:
    """Whether a master URL runs driver and tasks in one process."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused; on a cluster
    the folder's owner removes what is in it)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/moodspark/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df):
    """Cut lineage by writing to the shared checkpoint folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Fits of one driver may run in several threads, and a file is served under its name once.
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give Python tasks this package, as ``--py-files`` would, once a session: its code
    is zipped in the driver's own folder, served to executors by Spark, and removed when
    the driver ends.  A local master's tasks import it from where the driver does."""
    sc = spark.sparkContext
    if is_local(sc.master):
        return
    with _SHIPPING:
        if getattr(sc, "_moodspark_package", None):
            return
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="moodspark-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "moodspark_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(package):
                for name in names:
                    if name.endswith((".py", ".txt")):
                        full = os.path.join(at, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        sc._moodspark_package = path
