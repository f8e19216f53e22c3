"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; without that setting a temporary one, in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="facetloom-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def unsorted(spark: SparkSession, writers: int = 64) -> Iterator[None]:
    """Within, a task of a partitioned write keeps a file open for each of up to so many values, and sorts only what comes after: its memory doesn't grow with its rows."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(writers))
    try:
        yield
    finally:
        spark.conf.set(name, before)
