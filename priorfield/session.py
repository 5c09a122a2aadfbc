"""Session settings the library reads, and the shared folder for cut lineages."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


_FALLBACK: dict[str, str] = {}  # by application
_OWN: list[str] = []  # folders of open own_folder blocks


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. A temporary one only if none is named and the driver
    and all tasks are one process; on a cluster a missing setting is an error."""
    if _OWN:
        return _OWN[-1]
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if path:
        return path
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="priorfield-")
    return _FALLBACK[context.applicationId]


@contextmanager
def own_folder(spark: SparkSession):
    """Copies written inside the block go to a folder of their own, removed at its end.

    Frames built inside must be used up (written or collected) before the block ends.
    """
    path = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    _OWN.append(path)
    try:
        yield path
    finally:
        _OWN.remove(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    Used where several branches of a plan read the same expensive frame: the copy survives
    lost executors, and column pruning and pushdown work on it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Rows go to Python workers at most ``rows`` at a time; for long texts beside work that needs the memory.

    Frames built inside must be used up (written or collected) before the block ends.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
