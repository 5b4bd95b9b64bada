"""Lineage cuts that survive losing an executor: tables written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; only a local master may fall back."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = "file://" + tempfile.mkdtemp(prefix="assetlens-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


# Spark's switch for removing an execution's shuffle files when it ends; without it they stay until the JVM collects the plan.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    was = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if was is None else conf.set(FREE_SHUFFLES, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and restart the plan from that table.

    Readers prune columns and skip row groups; the folder goes when the driver ends. The shuffles behind the
    table go as soon as it is written, so a plan holds on disk the shuffles of one step at a time.
    """
    return _written(df, new_folder(df.sparkSession, "cut"))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yield a ``cut`` for tables that only later steps of the block read: they are removed when it ends.

    A frame that leaves the block must not read them: ``cut`` it inside.
    """
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(new_folder(spark, "passing"))
        return _written(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
