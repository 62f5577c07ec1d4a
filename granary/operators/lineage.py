"""Where iterative operators end their lineage: the folder that the driver and all executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and Spark runs in one process, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that a lost executor loses nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint()
