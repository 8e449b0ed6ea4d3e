"""Shared-folder scratch space: where operators cut lineage so that a lost executor never loses a result.

The folder is the one the cluster names in ``spark.checkpoint.dir``. A temporary one is set only where the session names none
and runs in local mode (tests, notebooks); on a cluster that is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not root:
        held = jsc.getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="headwater-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; removed when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/headwater-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = where
    return written


def appended(written: DataFrame | None, df: DataFrame, name: str) -> DataFrame:
    """``df`` written behind the rows of a table of ``materialize``, or as the first of them."""
    if written is None:
        return materialize(df, name)
    df.write.mode("append").parquet(written._scratch.toString())
    again = df.sparkSession.read.schema(df.schema).parquet(written._scratch.toString())
    again._scratch = written._scratch
    return again


def discard(written: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    written._scratch.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(written._scratch, True)


#: Rows of a few numbers each that may be broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast only if its rows are counted and few; else joins shuffle."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def local_path(path: str) -> str:
    """A model file as a task sees it: the path itself, or the copy that ``SparkContext.addFile`` gave out."""
    if os.path.exists(path):
        return path
    return SparkFiles.get(os.path.basename(path))
