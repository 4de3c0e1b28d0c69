"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset a local session gets a temporary folder;
    on a cluster that would be one machine's own, so it is an error."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfield-"))
        told = sc.getCheckpointDir()
    return told.rstrip("/")


def partitioned(df: DataFrame, *by: str) -> DataFrame:
    """Write as a dataset partitioned by columns and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.parquet(path)
