"""Blending a selection with general data, and the random baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from .selection import hash_sample, prefix_sum

BATCH = 10_000


def with_ordinal(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """docs with `ordinal`, their place from 0 in order of a unique key, without a global sort."""
    one = docs.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    return prefix_sum(one, "_one", "_all", order, into="ordinal").drop("_all", "_one")


def blend(primary: DataFrame, general: DataFrame, rows: int, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """(position, source, ordinal, text): exactly so many rows, each from the primary documents with
    probability ratio, else from the general ones; either source begins anew when it is used up.

    Both hold doc_id and text. An empty source leaves its share to the other.
    """
    counts = {"primary": primary.count(), "general": general.count()}
    if not any(counts.values()):
        raise ValueError("both sources are empty")
    share = ratio if all(counts.values()) else float(counts["primary"] > 0)
    spark = primary.sparkSession
    drawn = spark.range(rows).select(F.col("id").alias("position"), F.when(unit_hash(seed, F.col("id")) < share, F.lit("primary")).otherwise(F.lit("general")).alias("source"))
    placed = prefix_sum(drawn.withColumn("_one", F.lit(1)), "_one", "source", "position", into="nth").drop("_one")
    size = F.when(F.col("source") == "primary", F.lit(counts["primary"])).otherwise(F.lit(counts["general"]))
    placed = placed.withColumn("ordinal", F.when(size > 0, F.pmod("nth", size)))
    texts = with_ordinal(primary.select("doc_id", "text")).withColumn("source", F.lit("primary")).unionByName(with_ordinal(general.select("doc_id", "text")).withColumn("source", F.lit("general")))
    return placed.join(texts, ["source", "ordinal"]).select("position", "source", "ordinal", "doc_id", "text")


def batches(rows: DataFrame, order: str = "position", size: int = BATCH) -> DataFrame:
    """rows with `shard`, the number of the file of fixed size they belong to; order counts from 0."""
    return rows.withColumn("shard", F.floor(F.col(order) / size).cast("int"))


def random_baseline(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """As many documents as the selection has, at random: matched by count, not by tokens."""
    return hash_sample(docs, n, seed)
