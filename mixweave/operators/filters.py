"""Quality filters: each takes documents with cluster_id and returns them with labels filtered."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FilterConfig
from ..functions.columns import clean, row_mean
from .clusters import prune


class QualityFilter(ABC):
    def __init__(self, config: FilterConfig | None = None):
        self.config = config or FilterConfig()

    @abstractmethod
    def apply(self, docs: DataFrame, quality: Sequence[str]) -> DataFrame: ...


def passes(quality: Sequence[str], config: FilterConfig) -> Column:
    """Whether a document's criteria suffice: the one at english_index where there are at least
    three, and the mean of all."""
    cells = [clean(F.col(c)) for c in quality]
    good = row_mean(cells) >= config.doc_composite_min
    return (cells[config.english_index] >= config.doc_english_min) & good if len(cells) >= 3 else good


class NoFilter(QualityFilter):
    def apply(self, docs: DataFrame, quality: Sequence[str]) -> DataFrame:
        return docs


class DocLevelFilter(QualityFilter):
    def apply(self, docs: DataFrame, quality: Sequence[str]) -> DataFrame:
        if not quality:
            return docs
        return docs.withColumn("cluster_id", F.when(passes(quality, self.config), F.col("cluster_id")).otherwise(F.lit(-1)))


class ClusterLevelFilter(QualityFilter):
    def apply(self, docs: DataFrame, quality: Sequence[str]) -> DataFrame:
        return prune(docs, quality, self.config.cluster_avg_threshold)


class DocAndClusterFilter(QualityFilter):
    """Documents first, then clusters; a document that was dropped stays dropped."""

    def apply(self, docs: DataFrame, quality: Sequence[str]) -> DataFrame:
        return ClusterLevelFilter(self.config).apply(DocLevelFilter(self.config).apply(docs, quality), quality)


FILTERS: dict[str, type[QualityFilter]] = {"none": NoFilter, "doc_level": DocLevelFilter, "cluster_level": ClusterLevelFilter, "doc_and_cluster": DocAndClusterFilter}


def get_filter(config: FilterConfig) -> QualityFilter:
    if config.method not in FILTERS:
        raise ValueError(f"unknown filter {config.method!r}; there are {', '.join(FILTERS)}")
    return FILTERS[config.method](config)
