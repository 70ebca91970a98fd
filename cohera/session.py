"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "cohera") -> SparkSession:
    """Build (or reuse) a session tuned for these jobs.

    On a cluster the master, memory and checkpoint folder come from the
    submitter; locally (tests, bench) we fill in sensible defaults.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode runs every task inside the driver JVM
            b = b.config("spark.driver.memory", os.environ.get("COHERA_DRIVER_MEMORY", "16g"))
            # one process: a local folder is the shared one. A cluster names its own.
            b = b.config("spark.checkpoint.dir", os.environ.get("COHERA_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="cohera-ckpt-"))
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_REGISTERED: set = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Raises where it is unset: a machine-local folder would lose data on a
    cluster. The folder is registered for ``Dataset.checkpoint`` once an
    application."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _REGISTERED and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    _REGISTERED.add(app)
    return d


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{tag}-{uuid.uuid4().hex}"


def materialise(df, tag: str):
    """Write ``df`` to the shared checkpoint folder and read it back: what
    several jobs read is computed once, held by no executor, and its size is
    known to the optimiser."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table under the checkpoint folder. For the owner
    of that folder, when no result that reads them is in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
