"""Tables written once to the cluster's shared folder, so that several steps read them and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, as in tests, a temporary one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="assetlens-text-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


ROWS_A_FILE = 50_000  # of narrow tables


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder.

    ``rows`` is a bound of a narrow table's rows: it is then written by as many tasks as that takes, not by
    one for each shuffle partition, since each file of a few rows costs more than its rows do.
    """
    path = new_folder(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
