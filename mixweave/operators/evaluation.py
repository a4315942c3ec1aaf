"""Running experiments: one per mixture, in turn or several at a time.

Training is external. An experiment takes an id and weights and returns accuracies and likelihood
losses by benchmark; one that fails counts as a result without any.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np

from .search import Evaluator, Metrics

Experiment = Callable[[int, np.ndarray], Metrics]
log = logging.getLogger(__name__)


@dataclass
class ExperimentResult:
    config_id: int
    weights: list[float]
    per_task_accuracies: dict[str, float] = field(default_factory=dict)
    per_task_nlls: dict[str, float] = field(default_factory=dict)
    seconds: float = 0.0
    error: str | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ExperimentResult:
        return cls(**json.loads(text))


def run_experiment(experiment: Experiment, config_id: int, weights: Sequence[float]) -> ExperimentResult:
    began, done = time.time(), ExperimentResult(config_id, [float(w) for w in weights])
    try:
        done.per_task_accuracies, done.per_task_nlls = experiment(config_id, np.asarray(weights, float))
    except Exception as e:  # a failed run is a result, and says so
        log.warning("experiment %s failed: %s", config_id, e)
        done.error = f"{type(e).__name__}: {e}"
    done.seconds = time.time() - began
    return done


def run_batch(experiment: Experiment, ids: Sequence[int], weights: np.ndarray, at_once: int = 1) -> list[ExperimentResult]:
    """Results in the order of ids; at_once of them run at a time, group after group."""
    out: list[ExperimentResult] = []
    for first in range(0, len(ids), max(1, at_once)):
        group = list(zip(ids[first : first + at_once], weights[first : first + at_once], strict=True))
        with ThreadPoolExecutor(max(1, len(group))) as pool:
            out += pool.map(lambda g: run_experiment(experiment, *g), group)
    return out


def evaluator(experiment: Experiment, at_once: int = 1, keep: Callable[[ExperimentResult], None] | None = None) -> Evaluator:
    """An experiment as what MixtureSearch asks; keep gets each result, under its configuration id."""

    def evaluate(ids: list[int], weights: np.ndarray) -> list[Metrics]:
        results = run_batch(experiment, ids, weights, at_once)
        for r in results:
            if keep:
                keep(r)
        return [(r.per_task_accuracies, r.per_task_nlls) for r in results]

    return evaluate


def run_target(experiment: Experiment, weights: Sequence[float]) -> ExperimentResult:
    """The target model on the mixture that was found; its id is -1."""
    return run_experiment(experiment, -1, weights)
