"""Cluster discovery: by domain and quality tier, or by embedding; then prune and merge."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DiscoveryConfig
from ..functions.columns import clean, row_mean
from .clusters import cluster_info, merge_clusters, nearest_centroid, propagate, prune
from .selection import hash_sample, ranked


class ClusterDiscovery(ABC):
    def __init__(self, config: DiscoveryConfig | None = None):
        self.config = config or DiscoveryConfig()

    @abstractmethod
    def discover(self, docs: DataFrame, quality: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(docs with cluster_id, cluster information)."""


def code_domains(docs: DataFrame, domain: str, names: Sequence[str] = (), into: str = "domain") -> DataFrame:
    """docs with an integer domain: a number is itself, a string its place among the declared names
    or, without those, among all values in order; null and unknown are -1."""
    kind = docs.schema[domain].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return docs.withColumn(into, F.coalesce(F.col(domain).cast("int"), F.lit(-1)))
    if names:
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(domain)) - 1
        return docs.withColumn(into, F.coalesce(place, F.lit(-1)).cast("int"))
    codes = docs.where(F.col(domain).isNotNull()).select(F.col(domain).alias("_d")).distinct().withColumn("_code", (F.row_number().over(W.orderBy("_d")) - 1).cast("int"))
    return docs.join(codes, docs[domain] == codes["_d"], "left").drop("_d").withColumn(into, F.coalesce("_code", F.lit(-1))).drop("_code")


def quality_tiers(docs: DataFrame, quality: Sequence[str], tiers: int) -> DataFrame:
    """docs (doc_id, domain, ...) with cluster_id = domain * tiers + tier.

    In each domain, documents in order of mean quality, ties by id, fall into tiers of equal size:
    the k-th holds positions from k * n / tiers up to (k + 1) * n / tiers, both rounded down.
    """
    mean = row_mean([clean(F.col(c)) for c in quality]) if quality else F.lit(0.0)
    places = ranked(docs.withColumn("_mean", mean), "domain", "_mean")
    tier = F.floor((F.col("rank") * tiers - 1) / F.col("group_rows"))
    return places.withColumn("cluster_id", F.when(F.col("domain") >= 0, F.col("domain") * tiers + tier).otherwise(F.lit(-1)).cast("int")).drop("_mean", "rank", "group_rows")


def quality_centroids(docs: DataFrame, quality: Sequence[str]) -> DataFrame:
    """(cluster_id, centroid): the mean of each criterion; only clusters that have documents."""
    means = [F.avg(clean(F.col(c))) for c in quality] or [F.lit(0.0)]
    return docs.where("cluster_id >= 0").groupBy("cluster_id").agg(F.array(*means).alias("centroid"))


class QualityClusterDiscovery(ClusterDiscovery):
    def discover(self, docs: DataFrame, quality: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        c = self.config
        domains = docs.where("domain >= 0").select("domain").distinct().count()
        if not domains:
            raise ValueError("no document has a domain")
        tiered = quality_tiers(docs, quality, max(1, c.k_init // domains))
        pruned = prune(tiered, quality, c.prune_threshold, keep_all_if_none=True)
        merged, centroids = merge_clusters(pruned, quality_centroids(pruned, quality), c.k_enhanced, c.merge_distance)
        return merged, cluster_info(merged, centroids)


def hashed_embeddings(docs: DataFrame, dim: int, text: str = "text") -> DataFrame:
    """docs with a unit embedding of hashed words: the embedder that needs no model."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.withColumn("_words", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def fit_centroids(vectors: DataFrame, k: int, measure: str = "cosine", max_iter: int = 20, restarts: int = 5, seed: int = 42) -> DataFrame:
    """(cluster_id, centroid) of the cheapest of several k-means fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector("embedding").alias("features")).persist()
    try:
        fits = [KMeans(k=k, maxIter=max_iter, seed=seed + i, distanceMeasure=measure).fit(data) for i in range(restarts)]
    finally:
        data.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")


class EmbeddingClusterDiscovery(ClusterDiscovery):
    """K-means on embeddings, of all documents or of a sample whose labels spread by domain.

    embed takes documents and returns them with a unit `embedding`; without one, a column of that
    name is used if there is one, and hashed words if not.
    """

    def __init__(self, config: DiscoveryConfig | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, restarts: int = 5):
        super().__init__(config)
        self.embed, self.restarts = embed, restarts

    def discover(self, docs: DataFrame, quality: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        c = self.config
        part = docs if not c.sample_size else hash_sample(docs, c.sample_size, c.seed)
        own = "embedding" in docs.columns
        vectors = self.embed(part) if self.embed else part if own else hashed_embeddings(part, c.embedding_dim)
        centroids = fit_centroids(vectors, c.k_init, c.measure, restarts=self.restarts, seed=c.seed)
        labelled = nearest_centroid(vectors, centroids, c.measure).drop("score", *([] if own else ["embedding"]))
        pruned = prune(labelled, quality, c.prune_threshold, keep_all_if_none=True)
        new_centroids = nearest_labels(labelled, pruned, centroids)
        merged, centroids = merge_clusters(pruned, new_centroids, c.k_enhanced, c.merge_distance)
        if c.sample_size:
            known = merged.select("doc_id", F.col("cluster_id").alias("_known"))
            joined = docs.join(known, "doc_id", "left").withColumn("cluster_id", F.coalesce("_known", F.lit(-1)))
            with_domain = joined if "domain" in docs.columns else joined.withColumn("domain", F.lit(0))
            merged = propagate(with_domain, F.col("_known").isNotNull()).drop("_known").select(*docs.columns, "cluster_id")
        return merged, cluster_info(merged, centroids)


def nearest_labels(before: DataFrame, after: DataFrame, centroids: DataFrame) -> DataFrame:
    """The centroids of the clusters that pruning kept, under their new ids."""
    ids = before.select("doc_id", F.col("cluster_id").alias("old")).join(after.select("doc_id", F.col("cluster_id").alias("new")), "doc_id")
    kept = ids.where("new >= 0").select("old", "new").distinct()
    return kept.join(centroids, kept["old"] == centroids["cluster_id"]).select(F.col("new").alias("cluster_id"), "centroid")


DISCOVERIES: dict[str, type[ClusterDiscovery]] = {"quality_cluster": QualityClusterDiscovery, "embedding_cluster": EmbeddingClusterDiscovery}


def get_discovery(config: DiscoveryConfig) -> ClusterDiscovery:
    if config.method not in DISCOVERIES:
        raise ValueError(f"unknown discovery {config.method!r}; there are {', '.join(DISCOVERIES)}")
    return DISCOVERIES[config.method](config)
