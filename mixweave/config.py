"""Layered configuration.

Fixed values: the defaults are those of the method.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.models import BENCHMARK_SIZES


@dataclass
class DiscoveryConfig:
    method: str = "quality_cluster"
    k_init: int = 1000
    k_enhanced: int = 10
    sample_size: int = 0
    prune_threshold: float = 3.0
    merge_distance: float = 1.5
    embedding_dim: int = 64
    measure: str = "cosine"
    seed: int = 42


@dataclass
class FilterConfig:
    method: str = "none"
    doc_english_min: float = 0.3
    doc_composite_min: float = 0.5
    cluster_avg_threshold: float = 3.0
    english_index: int = 2


@dataclass
class SearchConfig:
    configs_per_iter: list[int] = field(default_factory=lambda: [15, 8, 4])
    dirichlet_alpha: float | None = None
    sample_from_top_m: int = 32
    w_floor: float = 0.0
    pool_per_concentration: int = 25_000
    refine: int = 5_000
    include_pool_best: bool = False
    seed: int = 42


@dataclass
class PredictorConfig:
    method: str = "gbt"
    trees: int = 500
    learning_rate: float = 0.02
    max_depth: int = 3
    min_leaf: int = 3
    auto_adjust: bool = True
    seed: int = 42


@dataclass
class ModelConfig:
    depth: int = 20
    num_iterations: int | None = None
    ratio: float | None = None
    meta_dir: str | None = None


@dataclass
class MixtureConfig:
    discovery: DiscoveryConfig = field(default_factory=DiscoveryConfig)
    filtering: FilterConfig = field(default_factory=FilterConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    predictor: PredictorConfig = field(default_factory=PredictorConfig)
    proxy: ModelConfig = field(default_factory=ModelConfig)
    target: ModelConfig = field(default_factory=lambda: ModelConfig(depth=28))
    val_tasks: list[str] = field(default_factory=lambda: list(BENCHMARK_SIZES))
    primary_ratio: float = 0.7
    target_tokens: int | None = None
