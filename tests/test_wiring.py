import json
import random
import sys

import numpy as np
import pytest

from mixweave import cli
from mixweave.config import DiscoveryConfig, MixtureConfig, SearchConfig
from mixweave.operators import clusters, selection
from mixweave.plans.experiments import MixtureExperiments
from mixweave.plans.pipeline import run_pipeline, steps, write_run
from mixweave.sources import results, shards


def test_prefix_sum_keeps_null_and_sparse_keys(spark):
    rng = random.Random(1)
    rows = [(None, "a", 5), (3, None, 7), (None, None, 2), (9, None, 1)] + [(rng.randrange(1 << 60), rng.choice("ab"), rng.randint(1, 9)) for _ in range(300)]
    out = selection.prefix_sum(spark.createDataFrame(rows, "doc_id long, g string, v long"), "v", "g", range_docs=20).collect()
    assert len(out) == len(rows)
    for r in out:
        mine = [v for i, g, v in rows if g == r["g"] and (i is None or r["doc_id"] is not None and i < r["doc_id"])]
        assert r["doc_id"] is None or r["before"] == sum(mine)


def test_ranks_by_halving(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1]), float(rng.choice([1, 1, 1, 2, 3, rng.random()]))) for i in range(500)]
    for parts in (1, 2, 3, 7, 64):
        out = selection.ranked(spark.createDataFrame(rows, "doc_id long, g int, x double"), "g", "x", parts=parts, range_docs=50).collect()
        for g in (0, 1):
            want = [i for i, _, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))]
            assert [r["doc_id"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["rank"])] == want


def test_routes_to_files_of_any_size(spark):
    files = [("a", 0, 3), ("b", 3, 0), ("c", 3, 1000), ("d", 1003, 1), ("e", 1004, 0)]
    offsets = spark.createDataFrame(files, "shard_file string, start long, rows long")
    ids = [-5, 0, 2, 3, 4, 1002, 1003, 1004, 9999, 500, 500]
    out = shards.route(spark.createDataFrame([(i,) for i in ids], "doc_id long"), offsets)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = sorted((r["doc_id"], r["shard_file"], r["row_in_file"]) for r in out.collect())
    assert got == sorted([(-5, "a", 0), (0, "a", 0), (2, "a", 2), (3, "c", 0), (4, "c", 1), (1002, "c", 999), (1003, "d", 0), (1004, "d", 0), (9999, "d", 0), (500, "c", 497), (500, "c", 497)])


def test_vectors_that_fit_no_centroid(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 3.0])], "vec_id long, embedding array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 9.0])], "cluster_id int, centroid array<double>")
    of = lambda measure: {r["vec_id"]: (r["cluster_id"], r["score"]) for r in clusters.nearest_centroid(vectors, centroids, measure).collect()}
    assert of("cosine") == {1: (0, 1.0), 2: (-1, None), 3: (-1, None), 4: (-1, None), 5: (2, 27.0)}
    assert of("euclidean")[5] == (1, 3.0)


def test_validation_tasks_and_last_rows(spark):
    lines = ["a, 0, 0.5, 1", "b, 0, 0.1, 2", "a, 0, 0.75, 3", "c, 0, 0.9, 4"]
    frame = lambda rows: results.parse_eval_csv(spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "run long, line_no long, value string"))
    one = lambda rows, *a: [(r["acc"], r["nll"]) for r in results.aggregate_metrics(frame(rows), "run", *a).collect()]
    assert one(lines, ["a", "b", "z"]) == [((0.75 + 0.1) / 2, 2.5)] and one(lines, ["z"]) == [(0.0, 0.0)]
    assert one([*lines, "STEM, 0, n/a, 7"], ["a"]) == [(0.75, 7.0)]  # the loss counts without an accuracy
    assert one([*lines, "STEM, 0, 0.3, 7", "STEM, 0, 0.2, bad"], ["a"]) == [(0.2, 3.0)]


def collection(spark, n=120):
    return spark.createDataFrame([(i, f"text {i}", i % 3, 10, float(i % 5 + 1)) for i in range(n)], "doc_id long, text string, domain int, tokens long, q1 double")


def small_config(meta_dir=None):
    config = MixtureConfig(discovery=DiscoveryConfig(k_init=9, k_enhanced=3, prune_threshold=1.0), search=SearchConfig(configs_per_iter=[2, 1], pool_per_concentration=100, refine=20), val_tasks=["a"])
    config.target_tokens = 300
    config.proxy.meta_dir, config.proxy.ratio, config.proxy.depth = meta_dir, 2.0, 99
    return config


def test_experiments_per_configuration_target_cache_and_resume(spark, tmp_path):
    texts, trained = collection(spark), []
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "meta_1.json").write_text(json.dumps({"model_config": {"n_layer": 14}}))
    config = small_config(str(tmp_path / "meta"))
    assert steps(spark, config.proxy) == int(2.0 * 164_167_000 / 500_000) or steps(spark, config.proxy) > 600
    made = {}

    def train(folder, config_id, weights):
        rows = spark.read.parquet(folder)
        assert rows.where("name not like '%x'").count() > 0
        trained.append(config_id)
        made[config_id] = rows.count()
        return {"a": float(weights[0])}, {"a": 1.0 - float(weights[0])}

    def go(state=None, save=None):
        own = MixtureExperiments(texts, texts, config, str(tmp_path / "out"), train, general=spark.createDataFrame([(0, "general")], "doc_id long, text string"), files=2)
        return run_pipeline(texts.drop("text"), ["q1"], config, state=state, save=save, cache_dir=str(tmp_path / "cache"), cache_key="v1", experiments=own, target=True)

    saved = []
    run = go(save=lambda s: saved.append(s.to_json()))
    assert trained == [*range(3), -1] and len(saved) == 2 and run.target.per_task_accuracies["a"] == pytest.approx(float(run.weights[0]))
    for i in range(3):
        kept = json.loads((tmp_path / f"out/experiments/config_{i:05d}/result.json").read_text())
        assert kept["config_id"] == i and sum(kept["weights"]) == pytest.approx(1)
    assert len(list((tmp_path / "cache").iterdir())) == 2
    write_run(run, texts, str(tmp_path / "out"), config)
    assert json.loads((tmp_path / "out/target_result.json").read_text())["config_id"] == -1
    again = go(state=results.read_search_state(spark, str(tmp_path / "out/search.json")))
    assert trained.count(0) == 1 and len(again.state.weights) == 3 and np.isclose(again.weights.sum(), 1)
    run.release()


def test_command_line(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "data").mkdir()
    for k in range(2):
        ids = range(60 * k, 60 * k + 60)
        pq.write_table(pa.table({"text": [f"text number {i}" for i in ids], "cat": ["ab"[i % 2] for i in ids], "q1": [float(i % 5 + 1) for i in ids]}), tmp_path / "data" / f"part_{k}.parquet")
    (tmp_path / "schema.yaml").write_text("domain_col: cat\nquality_cols: [q1]\ntext_col: text\nprune_threshold: 1.0\n")
    script = tmp_path / "train.py"
    script.write_text("import sys\nopen(sys.argv[3], 'w').write('arc_easy, 0, 0.%02d, 1.5\\nCORE, 1, 1\\n' % (abs(int(sys.argv[2])) + 10))\n")
    options = ["--data-dir", str(tmp_path / "data"), "--schema", str(tmp_path / "schema.yaml"), "--output-dir", str(tmp_path / "out"), "--discovery-method", "quality_cluster", "--k-init", "4", "--k-enhanced", "2", "--configs-per-iter", "1,1", "--val-tasks", "arc_easy", "--cluster-cache-dir", str(tmp_path / "cache"), "--general-data-dir", str(tmp_path / "data"), "--target-tokens", "200"]
    cli.main([*options, "--train-command", f"{sys.executable} {script}"], spark)
    assert (tmp_path / "out/report.md").exists() and json.loads((tmp_path / "out/target_result.json").read_text())["per_task_accuracies"] == {"arc_easy": 0.11}
    assert len(results.read_search_state(spark, str(tmp_path / "out/search.json")).weights) == 2
    cli.main([*options, "--resume-search", "--skip-target"], spark)
    assert len(results.read_search_state(spark, str(tmp_path / "out/search.json")).weights) == 2
