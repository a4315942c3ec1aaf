"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a temporary one on a local master, else the warehouse's."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not hasattr(staging_dir, "made"):
        staging_dir.made = "file://" + tempfile.mkdtemp(prefix="mixweave-")
    return staging_dir.made


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for plans that read it several times; it outlives lost executors."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstaged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
