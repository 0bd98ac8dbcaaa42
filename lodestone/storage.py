"""Folders for what a query writes on its way: shared by driver and executors, gone when the session ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``.

    Where that is unset, a local master gets one in the temp folder; on a cluster it is an error, since a
    machine's own folder is not seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/lodestone"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has an existing folder deleted when the session's JVM ends."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(spark: SparkSession, kind: str, source: str, write) -> str:
    """The folder that ``write(path)`` filled for ``source``, written once in a session.

    The source's files must not change within the session.
    """
    key = (spark.sparkContext.applicationId, kind, source)
    if key not in _STORED:
        path = scratch(spark, kind)
        write(path)
        forget_at_exit(spark, path)
        _STORED[key] = path
    return _STORED[key]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to scratch and read back: later steps read it instead of computing it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
