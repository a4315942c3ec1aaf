"""Cluster tables: quality, information, pruning, merging, relabelling and propagation.

Labels live in an integer column `cluster_id`; -1 means in no cluster and stays -1 throughout.
Tables with a row per cluster are small beside the documents; they are broadcast by Catalyst when
its statistics say so, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import UNJUDGED, clean, total


def cluster_quality(docs: DataFrame, quality: Sequence[str]) -> DataFrame:
    """(cluster_id, num_docs, quality): the mean of all quality cells of each cluster.

    Without criteria, or where all cells are 0, each cluster has the quality of the unjudged.
    """
    inside = docs.where("cluster_id >= 0")
    if not quality:
        return inside.groupBy("cluster_id").agg(F.count("*").alias("num_docs"), F.lit(UNJUDGED).alias("quality"))
    cells = [clean(F.col(c)) for c in quality]
    sums = docs.select("cluster_id", total(cells).alias("s"), F.greatest(*[F.abs(c) for c in [*cells, F.lit(0.0)]]).alias("top")).groupBy("cluster_id").agg(F.count("*").alias("num_docs"), F.sum("s").alias("s"), F.max("top").alias("top"))
    judged = F.max("top").over(W.partitionBy()) > 0  # over a row per cluster; also of documents in none
    rated = sums.withColumn("quality", F.when(judged, F.col("s") / (F.col("num_docs") * len(quality))).otherwise(F.lit(UNJUDGED)))
    return rated.where("cluster_id >= 0").select("cluster_id", "num_docs", "quality")


def cluster_info(docs: DataFrame, centroids: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """(cluster_id, num_docs, num_tokens, avg_tokens, label), and centroid and quality if given."""
    info = docs.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("num_docs"), F.sum("tokens").cast("long").alias("num_tokens"))
    info = info.withColumn("avg_tokens", F.col("num_tokens") / F.col("num_docs")).withColumn("label", F.concat(F.lit("C"), F.col("cluster_id").cast("string")))
    if centroids is not None:
        info = info.join(centroids.select("cluster_id", "centroid"), "cluster_id", "left").withColumn("centroid", F.coalesce("centroid", F.array(F.lit(0.0))))
    if quality is not None:
        info = info.join(quality.select("cluster_id", "quality"), "cluster_id", "left")
    return info


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.where("cluster_id >= 0").groupBy("cluster_id").agg(F.sum("tokens").cast("long").alias("num_tokens"))


def kept_ids(quality: DataFrame, threshold: float, keep_all_if_none: bool = False) -> DataFrame:
    """(cluster_id, new_id) of clusters that reach the threshold, numbered from 0 in order of id.

    keep_all_if_none: if none does, all stay as they are; discovery does that, filters don't.
    """
    passed = F.col("quality") >= threshold
    if keep_all_if_none:
        none = ~F.max(passed).over(W.partitionBy())
        quality, passed = quality.withColumn("none", none), passed | F.col("none")
    return quality.where(passed).select("cluster_id", (F.dense_rank().over(W.orderBy("cluster_id")) - 1).cast("int").alias("new_id"))


def relabel(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with cluster_id replaced by ids' new_id, -1 where it has none."""
    new = ids.select("cluster_id", "new_id")
    return docs.join(new, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("cluster_id") >= 0, F.coalesce("new_id", F.lit(-1))).otherwise(F.lit(-1))).drop("new_id")


def prune(docs: DataFrame, quality: Sequence[str], threshold: float, keep_all_if_none: bool = False) -> DataFrame:
    return relabel(docs, kept_ids(cluster_quality(docs, quality), threshold, keep_all_if_none))


def merge_centroids(centroids: Mapping[int, Sequence[float]], num_docs: Mapping[int, int], target_k: int | None = None, max_distance: float = 1.5, group_weighted: bool = False) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """Merge the closest pair of clusters again and again; returns old id -> new id and new centroids.

    With target_k, that alone ends it, else a closest pair beyond max_distance. Groups stand in the
    order they were formed in, and the first of equal distances goes. Centroids average by the
    documents of the two ids that name the groups, or of the whole groups if group_weighted. The
    distances are kept up from step to step, so a merge costs a row, not a matrix.
    """
    names = sorted(centroids)
    k = len(names)
    if not k:
        return {}, {}
    at = np.array([centroids[n] for n in names], np.float32)
    weight = {n: num_docs.get(n, 0) for n in names}
    groups = {n: [n] for n in names}
    live = np.ones(2 * k, bool)
    slot_name, points = list(names), list(at)  # a merged group takes a new slot at the end
    far = np.full((2 * k, 2 * k), np.inf)
    x = at.astype(float)
    far[:k, :k] = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if k * k * x.shape[1] <= 1 << 26 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    np.fill_diagonal(far, np.inf)
    while len(groups) > 1 and (target_k is None or len(groups) > target_k):
        used = len(points)
        i, j = divmod(int(np.argmin(far[:used, :used])), used)
        if not np.isfinite(far[i, j]) or target_k is None and far[i, j] > max_distance:
            break
        a, b = slot_name[i], slot_name[j]
        wa, wb = weight[a], weight[b]
        new = (points[i] * wa + points[j] * wb) / max(wa + wb, 1)
        name = min(a, b)
        joined = groups.pop(a) + groups.pop(b)
        groups[name] = joined
        if group_weighted:
            weight[name] = wa + wb
        live[[i, j]] = False
        far[[i, j]], far[:, [i, j]] = np.inf, np.inf
        points.append(np.asarray(new, np.float32))
        slot_name.append(name)
        others = [s for s in range(used) if live[s]]
        if others:
            d = np.sqrt(((np.array([points[s] for s in others], float) - points[used].astype(float)) ** 2).sum(1))
            far[used, others] = far[others, used] = d
    final = {name: n for n, name in enumerate(sorted(groups))}
    centroid_of = {slot_name[s]: points[s] for s in range(len(points)) if live[s]}
    return {old: final[name] for name, olds in groups.items() for old in olds}, {final[n]: centroid_of[n] for n in groups}


def ids_frame(like: DataFrame, ids: Mapping[int, int]) -> DataFrame:
    """A map of ids as a table (cluster_id, new_id); it has a row per cluster."""
    return like.sparkSession.createDataFrame(sorted(ids.items()), "cluster_id int, new_id int")


def merge_clusters(docs: DataFrame, centroids: DataFrame, target_k: int | None = None, max_distance: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """docs with merged labels, and the merged centroids (cluster_id, centroid)."""
    counts = docs.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows = counts.join(centroids, "cluster_id").select("cluster_id", "n", "centroid").collect()  # a row per cluster
    ids, merged = merge_centroids({r["cluster_id"]: r["centroid"] for r in rows}, {r["cluster_id"]: r["n"] for r in rows}, target_k, max_distance)
    table = docs.sparkSession.createDataFrame([(k, [float(v) for v in c]) for k, c in sorted(merged.items())], "cluster_id int, centroid array<double>")
    return relabel(docs, ids_frame(docs, ids)), table


def mode_by(docs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the commonest value of each group, the smallest of equally common ones."""
    counts = docs.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max(F.struct("n", (-F.col(value)).alias("least"))).alias("top")).select(group, (-F.col("top.least")).cast("int").alias(value))


def propagate(docs: DataFrame, sampled: Column) -> DataFrame:
    """Give unsampled documents, and sampled ones in no cluster, the commonest cluster of their
    domain's sampled documents; 0 where the domain has none or that is -1."""
    dominant = mode_by(docs.where(sampled), "domain", "cluster_id").withColumnRenamed("cluster_id", "dominant")
    dominant = dominant.withColumn("dominant", F.greatest("dominant", F.lit(0)))
    mine = F.when(sampled & (F.col("cluster_id") >= 0), F.col("cluster_id")).otherwise(F.coalesce("dominant", F.lit(0)))
    return docs.join(dominant, "domain", "left").withColumn("cluster_id", mine.cast("int")).drop("dominant")


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, measure: str = "cosine") -> DataFrame:
    """vectors with the id of the centroid of largest inner product, or by the measure "euclidean" the
    nearest one, the smallest id of equal ones; score is the inner product.

    There are as many centroids as were fitted, by configuration; they go along with the task, and a
    batch of vectors meets them in one matrix product of doubles. A vector that is null, of another
    length or with a null component is in no cluster and has no score.
    """
    rows = sorted((r["cluster_id"], r["centroid"]) for r in centroids.select("cluster_id", "centroid").collect())
    ids, matrix = np.array([i for i, _ in rows], np.int32), np.array([c for _, c in rows], float)
    lengths = (matrix * matrix).sum(1) / 2 if measure == "euclidean" and len(rows) else 0.0
    names = [c for c in vectors.columns if c not in ("cluster_id", "score")]
    schema = T.StructType([*vectors.select(*names).schema.fields, T.StructField("cluster_id", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("embedding"))
            values = [x.values for x in column]
            sound = np.array([v is not None and len(v) == matrix.shape[-1] and not v.null_count for v in values], bool)
            best, score = np.full(len(values), -1, np.int32), np.full(len(values), np.nan)
            if sound.any() and len(ids):
                scores = np.array([v.to_numpy() for v, ok in zip(values, sound, strict=True) if ok], float) @ matrix.T
                top = (scores - lengths).argmax(1)
                best[sound], score[sound] = ids[top], scores[np.arange(len(top)), top]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(score, mask=~sound)], names=[*names, "cluster_id", "score"])

    return vectors.select(*names).mapInArrow(run, schema)
