"""Mixing sources to target weights with DataFrame functions only.

Tokens are aggregated per source; the wanted shares, capped at a multiple of each source, give its
repetition rate; a document is emitted floor(rate) times plus one more time if a hash of its id
falls below the fraction.

Defined results: a null or empty text has size 0 and takes part with 0 words; documents with a null
source form one source, last in order; rows with equal id and text draw the same copy; a null id
draws by its text. An empty table gives an empty mix. Columns other than those named are kept, and
inputs may have columns called like the ones added, which are then replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_dimension, stage

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets from a frame (source, source_size) with one row for each source.

    Sources weigh as `weights`, repeating, in code point order with null last. They share
    share_percent of all words; none gets more than max_repeats times its size, and the excess is
    reshared by weight. The level at which that settles comes from one pass in order of cap/weight.
    The windows see a row per source, not per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (pos + 1).cast("int")).cast("long")
    caps = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    filled = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share_percent / F.lit(100.0) - filled) / left
    leveled = caps.withColumn("level", level)
    settled = F.max("level").over(everything)  # if the first sources were capped and the others not: at most the true level
    target = F.least(F.col("cap").cast("double"), settled * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return leveled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Add size, source_size, target, rate and copies to each document (doc_id, text, source)."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    sized = docs.select(*own).withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share_percent, max_repeats), "mix-targets")
    mixed = join_dimension(sized, targets, "source", F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    whole = F.floor("rate")
    extra = unit_hash(seed, F.col("doc_id"), F.col("text")) < F.col("rate") - whole
    return mixed.withColumn("copies", whole + extra.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as its copies say, with the columns of docs."""
    planned = plan_mix(docs, **options)
    repeats = F.expr("explode(sequence(cast(1 as long), copies))")
    return planned.where("copies > 0").withColumn("_copy", repeats).select(*docs.columns)


def mixing_query(docs: DataFrame) -> DataFrame:
    planned = plan_mix(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


MIXING_SQL = rf"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), caps AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)::BIGINT * {SHARE_PERCENT} / 100.0::DOUBLE
            - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM caps WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target
  FROM levels
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 't' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM copied
"""
