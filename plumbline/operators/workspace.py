"""Cutting lineage in loops, with tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, one in the
    warehouse, which executors share, or in local mode a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        local = context.master.startswith("local") and "cluster" not in context.master
        own = tempfile.mkdtemp(prefix="plumbline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/plumbline-{uuid.uuid4().hex}"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read back: any executor can read it if one is
    lost, and the planner knows its size. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/plumbline/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df``, to be joined by its keys and never broadcast. The planner goes by the
    compressed files and does not see rows unfold, so a whole registry can look small."""
    return df.hint("merge")


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark is not None else ():
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may already be gone at exit
            return
