"""Tables that iterative plans write to the shared folder and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.

    A temporary folder is set only where the session names none and runs in local mode; on a cluster executors would each write
    to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    named, held = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not held.isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="headwater-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its plan is not run again, executors may be lost, and the next plan knows the table's true size.

    A checkpoint would keep estimated sizes instead, which a loop of joins squares with every round. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/headwater-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
