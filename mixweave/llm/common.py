"""Helpers shared by the operators: staged tables and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A staged table is broadcast only up to both of these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
SLICE_ROWS = 512
#: Share of its largest heap that the driver may hold before a staged table makes it collect its garbage.
HEAP_SHARE = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, if the session names it.

    Without that setting, a local master gets a temporary folder and a cluster the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        made = getattr(shared_dir, "made", None)
        if made is None:
            made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="mixweave-")
        return made
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage if it holds more than HEAP_SHARE of its heap.

    Broadcasts and shuffles of plans that have run go only then. Over a chain of some fifty plans
    the heap may otherwise grow though little of it is still in use; a full collection gives the rest
    back to the system.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()
        heap.gc()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def staged_bytes(df: DataFrame) -> int:
    p, fs = _path(df.sparkSession, df._staged_path)
    return fs.getContentSummary(p).getLength()


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    p, fs = _path(df.sparkSession, df._staged_path)
    fs.delete(p, True)


def fits_broadcast(staged: DataFrame) -> bool:
    return staged_bytes(staged) <= BROADCAST_BYTES and staged.count() <= BROADCAST_ROWS


def join_dimension(facts: DataFrame, dim: DataFrame, key: str, salt_by: Column, salts: int = 32) -> DataFrame:
    """Left join of facts to a staged dimension with unique keys, nulls matching nulls.

    The dimension is broadcast if its written size allows. Otherwise it is repeated once for each
    salt and the facts are dealt by (key, salt), so that a key with a third of all rows is split.
    """
    right = dim.withColumnRenamed(key, "_dim_key")
    if fits_broadcast(dim):
        return facts.join(F.broadcast(right), facts[key].eqNullSafe(right["_dim_key"]), "left").drop("_dim_key")
    right = right.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    on = left[key].eqNullSafe(right["_dim_key"]) & (left["_salt"] == right["_dim_salt"])
    return left.join(right, on, "left").drop("_dim_key", "_dim_salt", "_salt")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that a worker holds few rows as Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
