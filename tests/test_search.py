import numpy as np
import pytest

from mixweave.config import MixtureConfig, SearchConfig
from mixweave.functions import models
from mixweave.operators import scoring, search


def test_concentration_takes_shares_twice():
    s = search.DirichletSampler([1, 3])
    assert np.allclose(s.concentration * s.shares, 2 * np.array([0.25, 0.75]) ** 2)
    assert np.allclose(search.DirichletSampler([0, 0]).shares, 0.5)


def test_draws_lie_on_the_simplex_and_repeat():
    a, b = (search.DirichletSampler([5, 3, 2], seed=1).sample(50) for _ in range(2))
    assert np.array_equal(a, b) and np.allclose(a.sum(1), 1)


def test_drawing_around_the_best_fills_up_from_the_prior():
    s = search.DirichletSampler([1, 1, 1])
    out = s.around(np.array([[0.8, 0.1, 0.1]]), 20, 500.0)
    assert out.shape == (20, 3) and abs(out[0, 0] - 0.8) < 0.1


def test_novel_keeps_all_if_nothing_is_new():
    pool = np.array([[0.25, 0.75], [0.5, 0.5]])
    assert len(search.novel(pool, pool)) == 2
    assert len(search.novel(pool, pool[:1] + 1e-6)) == 1


def test_scores_of_failed_runs_count_as_zero(spark):
    rows = [(0, "a", 0.2, 2.0), (1, "a", 0.4, 1.0)]
    df = spark.createDataFrame(rows, "config_id long, benchmark string, acc double, nll double")
    configs = spark.range(3).withColumnRenamed("id", "config_id")
    out = {r["config_id"]: r["score"] for r in scoring.mixture_scores(df, configs, ["a"], {"a": 10}).collect()}
    mine = search.snr_scores([({"a": 0.2}, {"a": 2.0}), ({"a": 0.4}, {"a": 1.0}), ({}, {})], ["a"])
    assert len(out) == 3 and np.isfinite(mine).all()
    dropped = scoring.mixture_scores(df, configs, ["a"], {"a": 10}, drop_failed=True)
    assert dropped.count() == 2


@pytest.mark.parametrize("floor", [0.0, 0.5])
def test_weight_floor_where_accuracy_is_constant(spark, floor):
    df = spark.createDataFrame([(i, "a", 0.3, float(i)) for i in range(3)], "config_id long, benchmark string, acc double, nll double")
    out = scoring.benchmark_scores(df, {"a": 100}, floor).collect()
    assert {r["w"] for r in out} == {floor}


def test_trees_learn_a_step_and_stop_early():
    rng = np.random.default_rng(0)
    x = rng.random((200, 4))
    y = (x[:, 1] > 0.5) * 3.0
    m = search.BoostedTrees().fit(x[:150], y[:150], x[150:], y[150:])
    assert m.score(x[150:], y[150:]) > 0.8 and len(m.trees) <= 500
    assert m.rank(x)[0] in np.flatnonzero(y == 0)


def test_search_resumes_where_it_stopped():
    config = MixtureConfig(search=SearchConfig(configs_per_iter=[12, 4, 4], pool_per_concentration=200, refine=50))
    saved = []
    whole = search.MixtureSearch(config, [4, 3, 2], save=lambda s: saved.append(s.to_json()))
    best = whole.run()
    assert len(saved) == 3 and abs(best.sum() - 1) < 1e-9
    again = search.MixtureSearch(config, [4, 3, 2], state=search.SearchState.from_json(saved[0]))
    assert again.predictor is not None and len(again.state.iterations) == 1
    again.run()
    assert len(again.state.weights) == 20 and len(again.state.iterations) == 3


def test_the_best_is_the_highest_score():
    known = lambda ids, w: [({"arc_easy": float(x[0])}, {"arc_easy": 1.0 - float(x[0])}) for x in w]
    config = MixtureConfig(search=SearchConfig(configs_per_iter=[40, 10], pool_per_concentration=500, refine=200, include_pool_best=True))
    best = search.MixtureSearch(config, [1, 1, 1], known).run()
    assert best[0] > 0.6


def test_held_out_split():
    assert not search.split_held(9).any()
    assert search.split_held(10).sum() == 5 and search.split_held(100).sum() == 20


@pytest.mark.parametrize(("n", "k", "depth", "leaf"), [(27, 10, 3, 3), (35, 10, 3, 3), (112, 21, 4, 5)])
def test_tree_parameters(n, k, depth, leaf):
    assert models.tree_params(n, k) == (depth, leaf)


def test_model_sizes():
    assert round(models.scaling_params({"n_layer": 14}) / 1e6, 1) == 164.2
    assert models.model_info(28) is None and models.model_info(24)["n_embd"] == 1536
    assert models.model_info(14, {"model_config": {"n_layer": 14}})["n_head"] == 7
    assert models.training_iterations(None, None, None) == 1000 and models.training_iterations(7, 2.0, 10) == 7


@pytest.mark.parametrize("at_once", [1, 3])
def test_batches_keep_order_and_survive_failures(at_once):
    from mixweave.operators import evaluation

    def experiment(i, w):
        if i == 2:
            raise RuntimeError("no device")
        return {"a": float(w[0])}, {"a": 1.0}

    kept = []
    out = evaluation.evaluator(experiment, at_once, kept.append)([0, 1, 2, 3], np.eye(4))
    assert [a for a, _ in out] == [{"a": 1.0}, {"a": 0.0}, {}, {"a": 0.0}]
    assert [r.config_id for r in kept] == [0, 1, 2, 3] and "no device" in kept[2].error
    assert evaluation.ExperimentResult.from_json(kept[0].to_json()) == kept[0]
    assert evaluation.run_target(experiment, [0.5, 0.5]).per_task_accuracies == {"a": 0.5}


def test_rows_of_a_pool_are_ranked_by_the_executors(spark, sf_dir, monkeypatch):
    from mixweave.plans import queries

    values = [0.5, -1.0, float("nan"), 0.5, 0.25, -1.0, 2.0, 0.5]
    rows = [(7 - i, v) for i, v in enumerate(values)] + [(None, 0.25)]
    pool = spark.createDataFrame(rows, "id long, w double").repartition(3)
    best = [(2, -1.0), (6, -1.0), (3, 0.25), (None, 0.25), (0, 0.5), (4, 0.5)]
    assert [tuple(r) for r in search.top_rows(pool, ["w"], "id", queries._FirstWeight(), 6).collect()] == best
    assert search.top_rows(pool.limit(0), ["w"], "id", queries._FirstWeight(), 6).count() == 0

    def collected(self):
        raise AssertionError("collected by the driver")

    with monkeypatch.context() as m:
        m.setattr(type(pool), "collect", collected)
        out = queries.QUERIES["l2_top_candidates"](spark, sf_dir)
    assert out.count() == 96
