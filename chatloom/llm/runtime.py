"""Session-level plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import arrow_batches, planned_parts, spread, table  # noqa: F401

#: White space of every word-based operator here: space and the controls 9-13.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share, as the session names it.

    Only a local session without one, as in tests, gets a folder of its own; a
    cluster without one is refused, since its machines share no temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="chatloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/chatloom/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here,

    and a lost executor costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Steps:
    """The tables that a job writes between its steps; they go when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """As cut(), in a table that end() deletes."""
        self.paths.append(scratch(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def next(self, df: DataFrame, label: str) -> DataFrame:
        """As cut(), in place of the last table, which only df still reads."""
        old = self.paths[-1]
        out = self.cut(df, label)
        delete(self.spark, old)
        self.paths.remove(old)
        return out

    def end(self, df: DataFrame, label: str) -> DataFrame:
        """The result as a table of its own; the steps before it are deleted."""
        out = cut(df, label)
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        free_shuffles(self.spark)
        return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
