"""The folder that driver and executors share, and the tables saved in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: paths that the innermost `scratch` of this thread has to delete
_open: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir.

    Where neither is set, a session on one machine (master local) gets a scratch folder; on a cluster that is an error, as
    each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tabwork-"))
    return "file://" + _local[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: worked out once, and there whichever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/tabwork-{name}-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators saved in the block, of this thread, when the block ends, whether it fails or not.

    Results are lazy and read these tables, so they have to be written, counted or collected inside the block:

        with scratch(spark):
            op(docs).write.parquet(path)

    A block inside of another one deletes its own tables only. A table that is gone already is no error.
    """
    own: list[str] = []
    mark = _open.set(own)
    try:
        yield
    finally:
        _open.reset(mark)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
