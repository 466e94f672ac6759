"""Small tables written once to the shared folder, so that plans that use them often read them instead of their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; only a single machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; a local one loses data with the master {master}")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/plumbline-panels/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and executors that are lost take nothing with them."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has settled."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
