"""Steps written to the folder that driver and executors share, and read again: a cut in the lineage that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of the warehouse, or, in a session of one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not found:
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-tidebar-")
        shared_dir.own = found
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again. The files go when the driver ends, or when `released`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _filesystem(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def released(*steps: DataFrame) -> None:
    """Delete the files of stored steps that nothing reads any more."""
    for df in steps:
        path = getattr(df, "_scratch_path", None)
        if path:
            target, files = _filesystem(df.sparkSession, path)
            files.delete(target, True)
