"""The folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, as in tests, a local folder, but only for a session of one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (given or local_folder(spark.sparkContext.applicationId)).rstrip("/")


@cache
def local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"docketeer-{application}-")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A name in the shared folder for what is of no use afterwards; it is deleted then."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def few(rows: DataFrame) -> DataFrame:
    """The rows themselves, so that they no longer need what they were read from: for results with a limit of their own."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def kept(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that they no longer need what they were read from."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
