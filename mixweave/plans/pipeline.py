"""The pipeline: load, discover, filter, search with an experiment per configuration, select, evaluate
the target, and write."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MixtureConfig, ModelConfig
from ..functions.models import model_info, training_iterations
from ..operators.blending import random_baseline
from ..operators.clusters import token_counts
from ..operators.discovery import ClusterDiscovery, get_discovery
from ..operators.evaluation import ExperimentResult
from ..operators.filters import get_filter
from ..operators.search import Evaluator, MixtureSearch, SearchState
from ..operators.selection import MixtureSampler, PrefixSampler, mixture_stats, selected_texts
from ..sources.results import latest_model_meta
from ..sources.shards import cached
from ..sources.sinks import cluster_json, markdown_report, weights_json, write_selected, write_shards, write_text
from ..sources.staging import staged, unstaged
from .experiments import MixtureExperiments, write_training_shards


@dataclass
class MixtureRun:
    docs: DataFrame
    selected: DataFrame
    clusters: DataFrame
    stats: DataFrame
    weights: np.ndarray
    state: SearchState
    seconds: dict[str, float]
    target: ExperimentResult | None = None

    def release(self) -> None:
        """Delete the run's staged documents; its frames can't be read any more."""
        unstaged(self.docs)


def discover_cached(docs: DataFrame, quality: Sequence[str], discovery: ClusterDiscovery, cache_dir: str, key: str) -> tuple[DataFrame, DataFrame]:
    """What discovery finds, kept under a key of the data and of the discovery's configuration."""
    name = hashlib.sha256(f"{key}|{type(discovery).__name__}|{discovery.config}|{list(quality)}".encode()).hexdigest()[:32]
    found: list[DataFrame] = []

    def make(i: int) -> DataFrame:
        if not found:
            found.extend(discovery.discover(docs, quality))
        return found[i]

    spark = docs.sparkSession
    return cached(spark, cache_dir, f"{name}-docs", lambda: make(0)), cached(spark, cache_dir, f"{name}-clusters", lambda: make(1))


def described_model(spark: SparkSession, model: ModelConfig) -> dict:
    """Sizes of a model: by its latest metadata where its folder has any, else by its depth."""
    return model_info(model.depth, latest_model_meta(spark, model.meta_dir) if model.meta_dir else None) or {}


def steps(spark: SparkSession, model: ModelConfig) -> int:
    scaling = int(described_model(spark, model).get("scaling_M", 0) * 1e6)
    return training_iterations(model.num_iterations, model.ratio, scaling or None)


def run_pipeline(
    docs: DataFrame, quality: Sequence[str], config: MixtureConfig | None = None, evaluate: Evaluator | None = None, state: SearchState | None = None,
    save: Callable[[SearchState], None] | None = None, weights: Sequence[float] | None = None, discovery: ClusterDiscovery | None = None,
    cache_dir: str | None = None, cache_key: str = "", experiments: MixtureExperiments | None = None, target: bool = False,
    sampler: MixtureSampler | None = None,
) -> MixtureRun:
    """Documents (doc_id, domain, tokens, criteria) to a selection.

    Labels from before the filter stay as original_cluster_id. Token counts come from the filtered
    labels, and clusters that the filter emptied get no weight. Given weights skip the search. With
    a cache folder, clusters are kept under cache_key, which should name the data. Experiments, whose
    documents are set to the filtered ones, evaluate each configuration, and the target if asked to.
    """
    config = config or MixtureConfig()
    seconds, began = {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        seconds[name], began = time.time() - began, time.time()

    method = discovery or get_discovery(config.discovery)
    found, clusters = discover_cached(docs, quality, method, cache_dir, cache_key) if cache_dir else method.discover(docs, quality)
    found = staged(found.withColumn("original_cluster_id", F.col("cluster_id")), "labelled")
    lap("discovery")
    filtered = get_filter(config.filtering).apply(found, quality)
    counts = {r["cluster_id"]: r["num_tokens"] for r in token_counts(filtered).collect()}  # a row per cluster
    tokens = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
    lap("filter")
    if not tokens:
        raise ValueError("no document is left in a cluster")
    if experiments is not None:
        experiments = replace(experiments, docs=filtered)
        evaluate = evaluate or experiments.evaluator()
    search = MixtureSearch(config, tokens, evaluate, state, save)
    mixture = np.asarray(weights, float) if weights is not None else search.run()
    lap("search")
    selected = (sampler or PrefixSampler()).select(filtered, mixture.tolist(), config.target_tokens)
    stats = mixture_stats(filtered, selected, mixture.tolist())
    lap("selection")
    result = experiments.run_target(mixture) if target and experiments is not None else None
    lap("target")
    return MixtureRun(found, selected, clusters, stats, mixture, search.state, seconds, result)


def write_run(run: MixtureRun, texts: DataFrame, path: str, config: MixtureConfig, general: DataFrame | None = None, files: int = 1) -> None:
    """Selected documents with their texts, training shards (blended if there are general documents),
    a random baseline of the same count, and the summaries."""
    spark = texts.sparkSession
    chosen = selected_texts(run.selected, texts, ("doc_id", "cluster_id", "original_cluster_id"))
    write_selected(chosen, f"{path}/selected")
    kept = spark.read.parquet(f"{path}/selected")
    n = write_training_shards(kept, f"{path}/shards", config.primary_ratio, general, files)
    write_shards(random_baseline(texts, n).select("doc_id", "text"), f"{path}/baseline", max(1, -(-n // files)))
    clusters = [r.asDict() for r in run.stats.orderBy("cluster_id").collect()]  # a row per cluster
    write_text(spark, f"{path}/weights.json", weights_json(run.weights, [f"C{i}" for i in range(len(run.weights))]))
    write_text(spark, f"{path}/clusters.json", cluster_json(run.clusters))
    write_text(spark, f"{path}/search.json", run.state.to_json())
    if run.target is not None:
        write_text(spark, f"{path}/target_result.json", run.target.to_json())
    parameters = {"Discovery": config.discovery.method, "Filter": config.filtering.method, "Proxy depth": config.proxy.depth, "Proxy steps": steps(spark, config.proxy), "Target depth": config.target.depth, "Target steps": steps(spark, config.target), "Clusters": config.discovery.k_enhanced, "Configs per iteration": config.search.configs_per_iter}
    write_text(spark, f"{path}/report.md", markdown_report(parameters, clusters, run.state.iterations, run.seconds))
