"""Experiments on mixtures: each configuration gets its own selection, shards and blend, then is trained.

Training is external: a trainer takes the folder of shards, an id and weights, and returns accuracies
and likelihood losses by benchmark. Folders are keyed by configuration; one that has a result already
isn't run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MixtureConfig
from ..operators.blending import blend
from ..operators.evaluation import ExperimentResult, evaluator, run_batch, run_target
from ..operators.search import Evaluator, Metrics
from ..operators.selection import select_by_mixture, selected_texts
from ..sources.results import read_text
from ..sources.sinks import exists, write_shards, write_text

Trainer = Callable[[str, int, np.ndarray], Metrics]
TARGET = -1


def write_training_shards(texts: DataFrame, path: str, ratio: float, general: DataFrame | None = None, files: int = 1) -> int:
    """Shards of selected texts (doc_id, text), blended if there are general documents; returns how
    many documents there are. A blend has as many rows as the selection."""
    n = texts.count()
    rows = texts.select("doc_id", "text")
    if general is not None and ratio < 1 and n:
        rows = blend(rows, general, n, ratio).select(F.col("position").alias("doc_id"), "text")
    write_shards(rows, path, max(1, -(-n // files)))
    return n


@dataclass
class MixtureExperiments:
    """Prepares and runs the configurations of a search, and the target."""

    docs: DataFrame
    texts: DataFrame
    config: MixtureConfig
    path: str
    train: Trainer
    general: DataFrame | None = None
    files: int = 1
    at_once: int = 1

    def folder(self, config_id: int) -> str:
        return f"{self.path}/target" if config_id == TARGET else f"{self.path}/experiments/config_{config_id:05d}"

    def prepare(self, config_id: int, weights: np.ndarray) -> str:
        """The folder of a configuration's training shards."""
        folder = self.folder(config_id)
        if not exists(self.texts.sparkSession, f"{folder}/shards/_SUCCESS"):
            chosen = select_by_mixture(self.docs, [float(w) for w in weights], self.config.target_tokens)
            write_training_shards(selected_texts(chosen, self.texts), f"{folder}/shards", self.config.primary_ratio, self.general, self.files)
        return f"{folder}/shards"

    def __call__(self, config_id: int, weights: np.ndarray) -> Metrics:
        """An experiment as evaluation.run_experiment wants it; a kept result is returned as it is."""
        spark, kept = self.texts.sparkSession, f"{self.folder(config_id)}/result.json"
        if exists(spark, kept):
            old = ExperimentResult.from_json(read_text(spark, kept))
            if old.error is None and np.allclose(old.weights, weights):
                return old.per_task_accuracies, old.per_task_nlls
        return self.train(self.prepare(config_id, weights), config_id, weights)

    def keep(self, result: ExperimentResult) -> None:
        write_text(self.texts.sparkSession, f"{self.folder(result.config_id)}/result.json", result.to_json())

    def evaluator(self) -> Evaluator:
        return evaluator(self, self.at_once, self.keep)

    def run_batch(self, ids: list[int], weights: np.ndarray) -> list[ExperimentResult]:
        return run_batch(self, ids, weights, self.at_once)

    def run_target(self, weights: np.ndarray) -> ExperimentResult:
        done = run_target(self, weights)
        self.keep(done)
        return done
