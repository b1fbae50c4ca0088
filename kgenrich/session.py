"""SparkSession helpers.

The library never creates a session on its own inside operators; jobs and
tests call :func:`get_spark`. On a cluster the session comes from the
launcher and only :func:`checkpoint_dir` is consulted.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "kgenrich", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session tuned for tests and the bench (UI off, AQE on)."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # reliable checkpoints are files in the shared folder: drop them once
        # the checkpointed data is no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("KG_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is
    unset and the master is local (tests) a fresh scratch folder is taken, once
    a session; on a cluster a machine-local folder would lose data, so that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="kg-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_runs: list[str] = []


def stage_folder(spark: SparkSession) -> str:
    """The folder for new stage tables: of the innermost ``stage_run``, if any."""
    return _runs[-1] if _runs else os.path.join(checkpoint_dir(spark), "stages")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table under the shared checkpoint folder."""
    return os.path.join(stage_folder(spark), uuid.uuid4().hex, name)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a stage table and read back. For loops: unlike a
    checkpoint, the table has the size of its files, where Spark's estimate of a
    chain of joins multiplies with every round until planning takes longer than the work."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` for a path of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def stage_run(spark: SparkSession):
    """Stage tables made inside go to a folder of their own, which is deleted at
    the end, so results must be written elsewhere before that. Runs can nest."""
    folder = os.path.join(stage_folder(spark), f"run-{uuid.uuid4().hex}")
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        fs, p = hadoop_path(spark, folder)
        fs.delete(p, True)
