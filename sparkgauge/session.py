"""Session-level helpers: lineage cuts for the few iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder used for checkpoints and written steps: the one that the context already uses, else the shared folder that
    ``spark.checkpoint.dir`` names.

    On a cluster a missing setting is an error.  A local-mode session without one, as in tests, where the driver is the only
    machine, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and restart its lineage there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of its own below the checkpoint folder and read it again.

    Like ``cut``, and the planner knows the size of what it reads, so that it broadcasts a small table and no other.  What the
    write has shuffled is deleted when it has ended.
    """
    target = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


@contextmanager
def _setting(spark: SparkSession, name: str, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Python workers get at most ``rows`` rows at a time: for stages whose rows hold several whole texts."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)
