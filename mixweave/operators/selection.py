"""Selecting documents to meet a token budget per cluster.

A cluster's documents are taken in document order until its budget is met; the one that crosses it
is taken too, so a document stays exactly if the tokens before it are below the budget.

Few clusters hold all documents, so a window per cluster would be a task per cluster. The running
sum is built in two levels instead: ranges of document ids are summed per cluster, those sums get a
prefix over a small table, and windows run inside a (cluster, range) only.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Document ids of a range.
RANGE_DOCS = 1 << 16
#: Parts that a group's values are cut into by quantiles where rows are ranked.
RANK_PARTS = 1000
#: The largest sample that is taken by a top-n plan.
TOP_SAMPLE = 10_000
FALLBACK_DOCS = 100


def prefix_sum(docs: DataFrame, value: str, by: str, order: str = "doc_id", range_docs: int = RANGE_DOCS, into: str = "before") -> DataFrame:
    """docs with the sum of value over the rows of the same group with a smaller order key.

    Null groups are a group and null keys come first; no row is lost. Ranges hold about range_docs
    rows of evenly spread keys, dense or sparse: their width follows the keys' span and number.
    """
    span = docs.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")).first()
    low, n = span["low"] or 0, max(span["n"], 1)
    width = max(1, ((span["high"] or 0) - low + 1) * range_docs // n)
    ranged = docs.withColumn("_range", F.floor((F.col(order) - F.lit(low)) / width))
    inner = W.partitionBy(by, "_range").orderBy(F.col(order).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(by).orderBy(F.col("_range").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    starts = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), start.alias("_start"))
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = summed.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_r")))
    return joined.withColumn(into, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_in", "_by", "_r", "_start")


def cuts_up_to(cuts: Column, value: Column, parts: int) -> Column:
    """How many of fewer than `parts` cuts in order are at most a value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(parts, 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value), at + step).otherwise(at))


def ranked(docs: DataFrame, by: str, value: str, order: str = "doc_id", parts: int = RANK_PARTS, range_docs: int = RANGE_DOCS) -> DataFrame:
    """docs with `rank`, from 1 in order of value and then order within the group, and `group_rows`.

    A window per group would be a task per group. Quantiles cut each group's values into parts
    instead; rows that equal a quantile, of which there may be any number, are cut by ranges of the
    order key. Parts are counted, the counts get a prefix, and windows run inside a part only.
    """
    cuts = docs.groupBy(by).agg(F.array_distinct(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).alias("_cuts"), F.count("*").alias("group_rows"))
    placed = docs.join(cuts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    placed = placed.withColumn("_place", cuts_up_to(F.col("_cuts"), F.col(value), parts))
    tied = F.coalesce(F.get("_cuts", F.col("_place") - 1) == F.col(value), F.lit(False))
    part = F.struct(F.col("_place").alias("p"), (~tied).alias("above"), F.when(tied, F.floor(F.col(order) / range_docs)).otherwise(F.lit(0)).alias("r"))
    placed = placed.withColumn("_part", part).drop("_cuts", "_place")
    counts = placed.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), start.alias("_start"))
    inner = placed.withColumn("_in", F.row_number().over(W.partitionBy(by, "_part").orderBy(value, order)))
    joined = inner.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn("rank", (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_in", "_by", "_at", "_start")


def budgets(weights: Sequence[float], total: Column) -> Column:
    """An array of budgets, each cut down to whole tokens."""
    return F.array(*[F.floor(F.lit(float(w)) * total).cast("long") for w in weights])


def select_by_mixture(docs: DataFrame, weights: Sequence[float], target_tokens: int | None = None, fallback: bool = True, seed: int = 42) -> DataFrame:
    """Rows of docs (doc_id, cluster_id, tokens) that the mixture takes, with their probability.

    Without a target, the budget is the tokens of all documents, in a cluster or not. Clusters
    beyond the weights are left out. If nothing is selected, up to 100 documents are, by a hash.
    """
    if target_tokens is None:
        target_tokens = int(docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"])
    inside = docs.where((F.col("cluster_id") >= 0) & (F.col("cluster_id") < len(weights)))
    budget = F.element_at(budgets(weights, F.lit(target_tokens)), F.col("cluster_id") + 1)
    whole = inside.groupBy("cluster_id").agg(F.sum("tokens").alias("cluster_tokens"))
    taken = prefix_sum(inside, "tokens", "cluster_id").withColumn("budget", budget).where(F.col("before") < F.col("budget"))
    rate = F.when(F.col("budget") >= F.col("cluster_tokens"), F.lit(1.0)).otherwise(F.col("budget") / F.col("cluster_tokens"))
    chosen = taken.join(whole, "cluster_id").withColumn("probability", rate).select(*docs.columns, "probability")
    if fallback and chosen.isEmpty():
        return hash_sample(docs, FALLBACK_DOCS, seed).withColumn("probability", F.lit(0.0))
    return chosen


class MixtureSampler(ABC):
    """Takes documents (doc_id, cluster_id, tokens) and weights to those that the mixture takes."""

    @abstractmethod
    def select(self, docs: DataFrame, weights: Sequence[float], target_tokens: int | None = None) -> DataFrame: ...


class PrefixSampler(MixtureSampler):
    """Documents in order until each cluster's budget is met."""

    def __init__(self, seed: int = 42):
        self.seed = seed

    def select(self, docs: DataFrame, weights: Sequence[float], target_tokens: int | None = None) -> DataFrame:
        return select_by_mixture(docs, weights, target_tokens, seed=self.seed)


def hash_sample(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """min(n, all) rows without replacement: those with the smallest hash of id and seed.

    A large sample is not sorted: hashes are counted by their first digits, and only the bucket in
    which the sample ends is put in order.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string")))
    if n <= TOP_SAMPLE:
        return docs.orderBy(digest, "doc_id").limit(n)
    bucketed = docs.withColumn("_bucket", F.substring(digest, 1, 4))
    before = F.sum("k").over(W.orderBy("_bucket")) - F.col("k")
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("k")).withColumn("before", before)
    last = counts.where(F.col("before") < n).agg(F.max(F.struct("_bucket", "before")).alias("last")).first()["last"]
    if last is None:
        return docs.limit(0)
    whole = bucketed.where(F.col("_bucket") < last["_bucket"])
    rest = bucketed.where(F.col("_bucket") == last["_bucket"]).orderBy(digest, "doc_id").limit(n - last["before"])
    return whole.unionByName(rest).drop("_bucket")


def selected_texts(selected: DataFrame, texts: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns of selected documents with their texts (doc_id, text), which only meet here."""
    return selected.select(*columns).join(texts.select("doc_id", "text"), "doc_id")


def mixture_stats(docs: DataFrame, selected: DataFrame, weights: Sequence[float]) -> DataFrame:
    """A row for every cluster 0..K-1: documents and tokens, original and selected, and their ratio."""
    spark = docs.sparkSession
    all_ids = spark.range(len(weights)).select(F.col("id").cast("int").alias("cluster_id"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("id") + 1).cast("int")).alias("weight"))
    count = lambda df, name: df.groupBy("cluster_id").agg(F.count("*").alias(f"{name}_docs"), F.sum("tokens").cast("long").alias(f"{name}_tokens"))
    joined = all_ids.join(count(docs, "original"), "cluster_id", "left").join(count(selected, "selected"), "cluster_id", "left").na.fill(0)
    return joined.withColumn("ratio", F.col("selected_docs") / F.greatest("original_docs", F.lit(1)))


def fractions(table: DataFrame, value: str, into: str) -> DataFrame:
    """A share of the column's total; unchanged where that is 0."""
    whole = F.sum(value).over(W.partitionBy())
    return table.withColumn(into, F.when(whole > 0, F.col(value) / whole).otherwise(F.col(value).cast("double")))
