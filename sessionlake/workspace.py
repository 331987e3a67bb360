"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none gets
    one of its own; on a cluster that is an error, as a folder of the driver's
    machine cannot be seen by executors."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sessionlake-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


_scratch: list[list[str]] = []


def written(df: DataFrame, name: str = "table", lasting: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, the same for every
    reader, and still there after an executor is lost. Inside `scratch` it is
    removed at the end unless it is lasting."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written in the block when it ends. What the block
    returns must not read them: write it as a lasting table."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no DataFrame reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
