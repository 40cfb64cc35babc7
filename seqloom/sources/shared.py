"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process that nobody has discarded, with the session that wrote them.
_written: dict[str, SparkSession] = {}


#: Folders made for local sessions that have none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's.

    A local session without one, as in tests, gets a temporary folder; a cluster's executors would
    not see each other's, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    here = spark.sparkContext.applicationId
    if here not in _local:
        _local[here] = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, _local[here], ignore_errors=True)
    return _local[here]


def stored(df: DataFrame, *, name: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors.

    The table stays until it is discarded or the process ends, as lazy results may still read it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _written[path] = df.sparkSession
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder for files that go when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote once nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path in _written:
        _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _leave() -> None:
    for path, spark in _written.items():
        if spark.sparkContext._jsc is None:
            break  # the engine has stopped: nothing can be reached any more
        _delete(path, spark)
