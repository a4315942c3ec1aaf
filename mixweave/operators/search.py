"""Search of the mixture simplex: Dirichlet draws, boosted trees, and the iterative loop.

All of the loop's state is bounded by configuration (at most some 100,000 candidates of K weights), so
it lives on the driver in numpy; nothing there grows with the corpus. A pool that is a table is ranked
by the executors (`top_rows`).
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..config import MixtureConfig, PredictorConfig
from ..functions.models import BENCHMARK_SIZES, DEFAULT_BENCHMARK_SIZE, column_fraction, tree_params

Metrics = tuple[dict[str, float], dict[str, float]]
#: Takes configurations (ids, weights) and returns each one's accuracies and likelihood losses.
Evaluator = Callable[[list[int], np.ndarray], list[Metrics]]


def concentration(tokens: np.ndarray, alpha: float | None = None) -> np.ndarray:
    """Dirichlet parameters: alpha, or K times the share; the sampler multiplies by shares again."""
    k, total = len(tokens), tokens.sum()
    if alpha is not None:
        return np.full(k, float(alpha))
    return np.ones(k) if total < 1 else tokens / total * k


class DirichletSampler:
    def __init__(self, tokens: Sequence[int], alpha: float | None = None, seed: int = 42, own: np.ndarray | None = None):
        counts = np.asarray(tokens, float)
        self.shares = counts / counts.sum() if counts.sum() >= 1 else np.full(len(counts), 1 / len(counts))
        self.concentration = concentration(counts, alpha) if own is None else own
        self.rng = np.random.default_rng(seed)

    def sample(self, n: int) -> np.ndarray:
        return self.rng.dirichlet(self.concentration * self.shares, size=n)

    def around(self, top: np.ndarray, m: int, sharpness: float = 5.0) -> np.ndarray:
        """m draws: one near each of the top ones, in random order, and the rest from the prior."""
        picked = top[self.rng.choice(len(top), size=min(m, len(top)), replace=False)]
        near = [self.rng.dirichlet(np.maximum(sharpness * w, 0.01)) for w in picked]
        extra = [self.sample(m - len(top))] if m > len(top) else []
        return np.concatenate([np.array(near), *extra])


def novel(pool: np.ndarray, tried: np.ndarray, digits: int = 4) -> np.ndarray:
    """Of the pool, those that differ from all tried ones when rounded; all if none does."""
    known = {tuple(r) for r in np.round(tried, digits)}
    fresh = [i for i, r in enumerate(np.round(pool, digits)) if tuple(r) not in known]
    return pool[fresh] if fresh else pool


def top_candidates(pool: np.ndarray, predictor: Predictor, most: int) -> np.ndarray:
    """Positions of the candidates with the lowest predictions, lowest first, ties in order."""
    return predictor.rank(pool)[: min(most, len(pool))]


def top_rows(pool: DataFrame, weights: Sequence[str], tie: str, predictor: Predictor, most: int) -> DataFrame:
    """The rows of a pool of any size with the lowest predictions on the weights, lowest first, ties by the column tie.

    Each task keeps the best `most` of what it has read, and of these the best are taken; nothing is
    collected by the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            rows = (some if best is None else pa.concat_tables([best, some])).sort_by(tie)
            at = top_candidates(np.column_stack([rows[w].to_numpy() for w in weights]), predictor, most)
            best = rows.take(pa.array(at))
        if best is not None:
            scores = predictor.predict(np.column_stack([best[w].to_numpy() for w in weights])).astype(float)
            yield from best.append_column("_score", pa.array(scores)).to_batches()

    scored = pool.mapInArrow(run, StructType([*pool.schema.fields]).add("_score", DoubleType()))
    return scored.orderBy("_score", F.col(tie).asc_nulls_last()).limit(most).drop("_score")


class Predictor(ABC):
    @abstractmethod
    def fit(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray | None = None, held_y: np.ndarray | None = None) -> Predictor: ...

    @abstractmethod
    def predict(self, x: np.ndarray) -> np.ndarray: ...

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(self.predict(x), kind="stable")

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        spread = ((y - y.mean()) ** 2).sum()
        return float(1 - ((y - self.predict(x)) ** 2).sum() / spread) if spread else 0.0


class BoostedTrees(Predictor):
    """Least-squares boosting of shallow trees with penalties on the leaves and early stopping."""

    def __init__(self, config: PredictorConfig | None = None, l1: float = 1.0, l2: float = 1.0, patience: int = 20):
        self.config, self.l1, self.l2, self.patience = config or PredictorConfig(), l1, l2, patience
        self.base, self.trees = 0.0, []

    def _value(self, g: np.ndarray | float, n: np.ndarray | float):
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0) / (n + self.l2)

    def _gain(self, g, n):
        return np.maximum(np.abs(g) - self.l1, 0) ** 2 / (n + self.l2)

    def _grow(self, x: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray, depth: int, least: int):
        g, n = r[rows].sum(), len(rows)
        best = (1e-12, None)
        if depth and n >= 2 * least:
            for c in cols:
                order = rows[np.argsort(x[rows, c], kind="stable")]
                v, left = x[order, c], np.cumsum(r[order])[:-1]
                k = np.arange(1, n)
                gain = self._gain(left, k) + self._gain(g - left, n - k) - self._gain(g, n)
                gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (c, (v[at] + v[at + 1]) / 2))
        if best[1] is None:
            return float(self._value(g, n))
        c, cut = best[1]
        below = x[rows, c] <= cut
        return c, cut, self._grow(x, r, rows[below], cols, depth - 1, least), self._grow(x, r, rows[~below], cols, depth - 1, least)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        c, cut, low, high = tree
        below, out = x[:, c] <= cut, np.empty(len(x))
        out[below], out[~below] = self._apply(low, x[below]), self._apply(high, x[~below])
        return out

    def fit(self, x, y, held_x=None, held_y=None):
        sound = np.isfinite(y)
        x, y = np.asarray(x, float)[sound], np.asarray(y, float)[sound]
        cfg = self.config
        depth, least = tree_params(len(x), x.shape[1], cfg.auto_adjust, cfg.max_depth, cfg.min_leaf)
        rng = np.random.default_rng(cfg.seed)
        use = max(1, round(column_fraction(x.shape[1]) * x.shape[1]))
        self.base, self.trees = float(y.mean()) if len(y) else 0.0, []
        at, held, best = np.full(len(x), self.base), None if held_x is None else np.full(len(held_x), self.base), (np.inf, 0)
        for k in range(cfg.trees if len(x) else 0):
            cols = np.sort(rng.choice(x.shape[1], use, replace=False))
            tree = self._grow(x, y - at, np.arange(len(x)), cols, depth, least)
            self.trees.append(tree)
            at += cfg.learning_rate * self._apply(tree, x)
            if held is not None:
                held += cfg.learning_rate * self._apply(tree, held_x)
                loss = float(((held_y - held) ** 2).mean())
                best = (loss, k + 1) if loss < best[0] else best
                if k + 1 - best[1] >= self.patience:
                    break
        if held is not None:
            self.trees = self.trees[: max(best[1], 1)]
        return self

    def predict(self, x):
        x = np.asarray(x, float)
        return self.base + self.config.learning_rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


PREDICTORS: dict[str, type[Predictor]] = {"gbt": BoostedTrees}


def get_predictor(config: PredictorConfig) -> Predictor:
    if config.method not in PREDICTORS:
        raise ValueError(f"unknown predictor {config.method!r}; there are {', '.join(PREDICTORS)}")
    return PREDICTORS[config.method](config)


def snr_scores(metrics: Sequence[Metrics], benchmarks: Sequence[str], w_floor: float = 0.0) -> np.ndarray:
    """The driver's form of scoring.mixture_scores, for the few configurations of a search."""
    score = np.zeros(len(metrics))
    for b in benchmarks:
        acc, nll = (np.array([m[i].get(b, 0.0) for m in metrics]) for i in (0, 1))
        f = 1 - 0.25 / BENCHMARK_SIZES.get(b, DEFAULT_BENCHMARK_SIZE) / (acc.var() + 1e-12)
        w = max(w_floor, min(1.0, max(0.0, (1 + f) / 2)))
        score += w * (acc - acc.mean()) / (acc.std() + 1e-12) - (1 - w) * (nll - nll.mean()) / (nll.std() + 1e-12)
    return score / max(len(benchmarks), 1)


def split_held(n: int, seed: int = 42) -> np.ndarray:
    """Which of n configurations are held out: a fifth, five at least, none of fewer than ten."""
    held = np.zeros(n, bool)
    if n >= 10:
        held[np.random.default_rng(seed).permutation(n)[n - max(5, int(n * 0.2)) :]] = True
    return held


def dry_run(benchmarks: Sequence[str]) -> Evaluator:
    """Made-up results, the same for the same ids, to try a pipeline without training."""

    def evaluate(ids: list[int], weights: np.ndarray) -> list[Metrics]:
        out = []
        for i in ids:
            rng = np.random.default_rng([1000, i])
            out.append(({b: float(rng.uniform(0, 0.1)) for b in benchmarks}, {b: float(rng.uniform(2, 4)) for b in benchmarks}))
        return out

    return evaluate


@dataclass
class SearchState:
    weights: list[list[float]] = field(default_factory=list)
    metrics: list[Metrics] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    iterations: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"last_completed_iter": len(self.iterations), "accumulated_scores": self.scores, "accumulated_configs": [{"weights": w, "config_id": i} for i, w in enumerate(self.weights)], "accumulated_per_benchmark": [{"acc": a, "nll": n} for a, n in self.metrics], "iterations": self.iterations})

    @classmethod
    def from_json(cls, text: str) -> SearchState:
        raw = json.loads(text)
        return cls([c["weights"] for c in raw["accumulated_configs"]], [(m["acc"] or {}, m["nll"] or {}) for m in raw["accumulated_per_benchmark"]], raw["accumulated_scores"], raw.get("iterations") or [{"iteration": i + 1} for i in range(raw["last_completed_iter"])])


class MixtureSearch:
    """Sample, evaluate, score, regress, again; then search the whole simplex with the regressor.

    A resumed search fits its regressor to the state it finds before it goes on.
    """

    def __init__(self, config: MixtureConfig, tokens: Sequence[int], evaluate: Evaluator | None = None, state: SearchState | None = None, save: Callable[[SearchState], None] | None = None):
        self.config, self.tokens = config, np.asarray(tokens, float)
        self.evaluate = evaluate or dry_run(config.val_tasks)
        self.state, self.save = state or SearchState(), save or (lambda s: None)
        self.sampler = DirichletSampler(self.tokens, config.search.dirichlet_alpha, config.search.seed)
        self.predictor: Predictor | None = None
        if self.state.weights:
            self.sampler.rng = np.random.default_rng([config.search.seed, len(self.state.weights)])
            self._fit()

    def _fit(self) -> float | None:
        x = np.array(self.state.weights)
        self.state.scores = snr_scores(self.state.metrics, self.config.val_tasks, self.config.search.w_floor).tolist()
        y = -np.array(self.state.scores)
        held = split_held(len(x))
        self.predictor = get_predictor(self.config.predictor)
        if not held.any():
            self.predictor.fit(x, y)
            return None
        self.predictor.fit(x[~held], y[~held], x[held], y[held])
        return self.predictor.score(x[held], y[held])

    def propose(self, n: int) -> np.ndarray:
        if self.predictor is None:
            return self.sampler.sample(n)
        pool = novel(self.sampler.sample(max(20 * n, 500)), np.array(self.state.weights))
        top = pool[top_candidates(pool, self.predictor, 3 * self.config.search.sample_from_top_m)]
        return self.sampler.around(top, n)

    def iterate(self, n: int) -> dict:
        new = self.propose(n)
        first = len(self.state.weights)
        self.state.metrics += self.evaluate(list(range(first, first + n)), new)
        self.state.weights += new.tolist()
        r2 = self._fit()
        scores = np.array(self.state.scores[first:])
        best = int(np.argmax(scores))
        done = {"iteration": len(self.state.iterations) + 1, "n_configs": n, "n_trained": len(new), "best_config": first + best, "best_score": float(scores[best]), "predictor_r2": r2}
        self.state.iterations.append(done)
        self.save(self.state)
        return done

    def full_search(self) -> np.ndarray:
        """The mixture the regressor likes best: of wide pools, and of draws around their best."""
        s, k = self.config.search, len(self.tokens)
        pools = [DirichletSampler(self.tokens, seed=s.seed + int(c), own=np.full(k, c)).sample(s.pool_per_concentration) for c in (1.0, 5.0, 10.0, 50.0)]
        pool = np.concatenate(pools)
        best = pool[[int(np.argmin(self.predictor.predict(pool)))]]
        refined = DirichletSampler(self.tokens, s.dirichlet_alpha, 999).around(best, s.refine, 50.0)
        if s.include_pool_best:
            refined = np.concatenate([refined, best])
        return refined[int(np.argmin(self.predictor.predict(refined)))]

    def run(self) -> np.ndarray:
        for n in self.config.search.configs_per_iter[len(self.state.iterations) :]:
            self.iterate(n)
        return self.full_search()
