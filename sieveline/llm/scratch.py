"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

Writing a table cuts lineage: an executor that is lost later costs no more than a read.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set (local sessions, tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of tables written by this process and not deleted since, oldest first.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again with its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Has the shuffle files of finished queries deleted.

    Spark deletes them when the driver's garbage is collected, which a driver that has little to do
    may put off until every shuffle of a long job lies on the disks.
    """
    for _ in range(2):  # what the first finds finished, listeners may still hold
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        _made.remove(path)


def forget(df: DataFrame) -> None:
    """Deletes the table that df reads, if written() made it; nothing may read it any more."""
    path = getattr(df, "_written_to", None)
    if path in _made:
        _delete(df.sparkSession, [path])


class Passing:
    """Within it, tables may be written; at its end all of them are deleted but the one that keep() named."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kept = spark, None

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept = df._written_to
        return df

    def __enter__(self) -> "Passing":
        self.before = set(_made)
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, [p for p in _made if p not in self.before and p != self.kept])
