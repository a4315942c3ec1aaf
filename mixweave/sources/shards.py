"""Document shards: identity, metadata scans, text lookup, and counts.

A document's id is its place in the collection: the rows of the files before its own, in order of
file name, plus its row in the file. The counts per file are a small table, so ids come without a
global sort and stay the same however the scan is split.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import char_count, clean, shard_number, tokens_from_chars
from ..functions.models import general_shards
from ..schema import DatasetSchema


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[tuple[str, int, int]]:
    """(name, bytes, modified) of the files that match, by name; an error if none does."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile():
        found = [fs.getFileStatus(hadoop)]
    else:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(hadoop, pattern)) or []
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
    if not files:
        raise FileNotFoundError(f"no {pattern} in {path}")
    return files


def read_shards(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All shards, with shard_file and row_in_file."""
    list_files(spark, path, pattern)
    rows = spark.read.option("pathGlobFilter", pattern).parquet(path)
    return rows.select("*", F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row_in_file"))


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(shard_file, shard, rows, start, end): a row per file, in order of name."""
    counts = shards.groupBy("shard_file").agg(F.count("*").alias("rows"))
    order = W.orderBy("shard_file")
    start = F.coalesce(F.sum("rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return counts.select("shard_file", shard_number(F.col("shard_file")).alias("shard"), "rows", start.alias("start"), (start + F.col("rows")).cast("long").alias("end"))


def with_doc_id(shards: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    offsets = shard_offsets(shards) if offsets is None else offsets
    return shards.join(offsets.select("shard_file", "start"), "shard_file").withColumn("doc_id", F.col("start") + F.col("row_in_file")).drop("start")


def scan_metadata(shards: DataFrame, schema: DatasetSchema) -> DataFrame:
    """doc_id, the domain column, cleaned quality, char_count and tokens; the text isn't read where
    character counts are stored."""
    if problems := schema.problems(shards):
        raise ValueError("; ".join(problems))
    chars = F.coalesce(F.col(schema.char_count_col), F.lit(0)).cast("long") if schema.char_count_col else char_count(F.col(schema.text_col))
    ided = shards if "doc_id" in shards.columns else with_doc_id(shards)
    return ided.select("doc_id", schema.domain_col, *[clean(F.col(q)).alias(q) for q in schema.quality], chars.alias("char_count"), tokens_from_chars(chars).alias("tokens"))


def read_texts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(position, doc_id, text) for requests (position, doc_id), which may repeat; an id that isn't
    there gives an empty text."""
    texts = docs.select("doc_id", F.col(text).alias("text"))
    return wanted.join(texts, "doc_id", "left").select("position", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def route(ids: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, shard_file, row_in_file): where each id lies; ids outside go to the nearest file's end.

    Ids and files meet in an equi-join on buckets of the id range, a few for each file.
    """
    files = offsets.where("rows > 0").select("shard_file", "start", "rows")
    size = files.agg(F.max(F.col("start") + F.col("rows")).alias("total"), F.count("*").alias("files")).first()
    total, width = size["total"] or 1, max(1, (size["total"] or 1) // (4 * max(size["files"], 1)))
    inside = F.greatest(F.lit(0), F.least(F.col("doc_id"), F.lit(total - 1)))
    placed = ids.withColumn("_at", inside).withColumn("_bucket", F.floor(F.col("_at") / width))
    spread = files.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("rows") - 1) / width))))
    met = placed.join(spread, "_bucket").where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + F.col("rows")))
    return met.select("doc_id", "shard_file", (F.col("_at") - F.col("start")).alias("row_in_file"))


def concatenate(*collections: DataFrame) -> DataFrame:
    """The rows of several collections, by column name; what a collection lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collections)


def read_general(spark: SparkSession, path: str, selected: int, ratio: float, pattern: str = "*.parquet") -> DataFrame:
    """The last shards of a general collection, as many as a blend with so many documents asks for,
    with shard_file and row_in_file."""
    names = last_shards([n for n, _, _ in list_files(spark, path, pattern)], general_shards(selected, ratio))
    rows = spark.read.parquet(*[f"{path.rstrip('/')}/{n}" for n in names])
    return rows.select("*", F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row_in_file"))


def first_shard_rows(shards: DataFrame, default: int = 10_000) -> int:
    row = shards.groupBy("shard_file").agg(F.count("*").alias("rows")).agg(F.min_by("rows", "shard_file").alias("rows")).first()
    return default if row["rows"] is None else int(row["rows"])


def last_shards(names: Sequence[str], count: int) -> list[str]:
    """The last so many files by shard number, those without a number first."""
    import re

    number = lambda n: int(m[1]) if (m := re.search(r"(\d+)", n)) else -1
    return sorted(names, key=lambda n: (number(n), n))[-count:] if count > 0 else []


def fingerprint(spark: SparkSession, path: str, pattern: str, *config: object) -> str:
    """Changes if a file's name, size or time does, or the configuration."""
    return hashlib.sha256(json.dumps([list_files(spark, path, pattern), [repr(c) for c in config]]).encode()).hexdigest()


def cached(spark: SparkSession, cache_dir: str, key: str, make) -> DataFrame:
    """What make() returns, kept as parquet under its key."""
    path = f"{cache_dir.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
