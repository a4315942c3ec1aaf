import json

import pytest
from pyspark.sql import functions as F

from mixweave.config import DiscoveryConfig, MixtureConfig, SearchConfig
from mixweave.operators import blending
from mixweave.plans.pipeline import run_pipeline, write_run
from mixweave.schema import DatasetSchema
from mixweave.sources import results, shards, sinks
from mixweave.streaming import ingest


@pytest.fixture
def folder(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 0
    for k, rows in ((10, 3), (2, 4), (7, 0)):
        ids = list(range(n, n + rows))
        pq.write_table(pa.table({"text": pa.array([f"text {i}" for i in ids], pa.string()), "cat": pa.array(["ab"[i % 2] for i in ids], pa.string()), "q1": pa.array([float("nan") if i == 1 else float(i) for i in ids], pa.float64())}), tmp_path / f"part_{k:02d}.parquet")
        n += rows
    return str(tmp_path)


def test_ids_follow_file_names_and_rows(spark, folder):
    rows = shards.read_shards(spark, folder)
    docs = shards.with_doc_id(rows).orderBy("doc_id").collect()
    assert [r["text"] for r in docs] == [f"text {i}" for i in (3, 4, 5, 6, 0, 1, 2)]
    assert [r["doc_id"] for r in docs] == list(range(7))
    assert shards.first_shard_rows(rows) == 4
    assert {r["shard"] for r in shards.shard_offsets(rows).collect()} == {2, 10}
    assert [f["start"] for f in json.loads(sinks.shard_index_json(shards.shard_offsets(rows)))] == [0, 4]


def test_missing_shards_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, str(tmp_path))


def test_metadata_scan_cleans_cells_and_checks_types(spark, folder):
    schema = DatasetSchema.from_dict({"domain_col": "cat", "quality_cols": [{"name": "q1", "higher_better": False}], "text_col": "text"})
    docs = shards.scan_metadata(shards.read_shards(spark, folder), schema).orderBy("doc_id").collect()
    assert [r["q1"] for r in docs][5] == 0.0 and {r["char_count"] for r in docs} == {6}
    bad = DatasetSchema.from_dict({"domain_col": "cat", "quality_cols": ["cat"], "text_col": "nope"})
    assert len(bad.problems(shards.read_shards(spark, folder))) == 2
    with pytest.raises(ValueError):
        DatasetSchema.from_dict({"quality_cols": ["q1"]})


def test_yaml_schema_and_projection(tmp_path):
    path = tmp_path / "schema.yaml"
    path.write_text("domain_col: cat\nquality_cols: [q1, {name: q2}]\ntext_col: text\nchar_count_col: n\nprune_threshold: 2.5\n")
    schema = DatasetSchema.from_yaml(str(path))
    assert schema.metadata_columns() == ["cat", "q1", "q2", "n"] and schema.prune_threshold == 2.5


def test_metadata_scan_does_not_read_texts(spark, sf_dir):
    schema = DatasetSchema.from_dict({"domain_col": "lang", "quality_cols": ["n_chars"], "text_col": "text", "char_count_col": "n_chars"})
    plan = shards.scan_metadata(spark.read.parquet(f"{sf_dir}/documents.parquet"), schema)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]


def test_text_lookup_repeats_and_defaults(spark):
    docs = spark.createDataFrame([(0, "a"), (1, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(0, 0), (1, 9), (2, 0), (3, 1)], "position long, doc_id long")
    assert [r["text"] for r in shards.read_texts(docs, wanted).orderBy("position").collect()] == ["a", "", "a", ""]


def test_cache_changes_with_files_and_configuration(spark, folder, tmp_path):
    one, two = (shards.fingerprint(spark, folder, "*.parquet", c) for c in ("x", "y"))
    assert one != two and one == shards.fingerprint(spark, folder, "*.parquet", "x")
    made = []
    for _ in range(2):
        assert shards.cached(spark, str(tmp_path / "cache"), one, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1


def test_last_shards():
    assert shards.last_shards(["s_2", "s_10", "s_9", "x"], 2) == ["s_9", "s_10"]


def test_eval_csv_rules(spark):
    lines = ["arc, 0.1, 0.5, 1.5", "gsm, 0.1, x, 2", "two, 3", "CORE, 1, 1, 1", "STEM, 0, 0.25", "math, 0, 0.75, bad"]
    rows = results.parse_eval_csv(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "run long, line_no long, value string"))
    assert {(r["task"], r["acc"], r["nll"], r["is_aggregate"]) for r in rows.collect()} == {("arc", 0.5, 1.5, False), ("STEM", 0.25, 0.0, True), ("math", 0.75, 0.0, False)}
    assert [(r["acc"], r["nll"]) for r in results.aggregate_metrics(rows, "run").collect()] == [(0.25, 0.75)]


def test_eval_log_last_report_counts(spark):
    lines = ["Evaluating: a (0-shot)... accuracy: 0.5 | centered: -0.25 | time: 2.0s", "noise", "Evaluating: a (0-shot)... accuracy: 0.75 | centered: 0.5 | time: 2.0s", "CORE metric: 0.125"]
    rows = results.parse_eval_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    assert {(r["task"], r["accuracy"], r["centered"]) for r in rows.collect()} == {("a", 0.75, 0.5), ("CORE metric", 0.125, None)}
    assert "+0.2500" not in sinks.validation_report(rows, rows) and "| a | 0.7500 | 0.7500 | +0.0000 |" in sinks.validation_report(rows, rows)
    assert results.core_metric("\n".join(lines)) == 0.125


def test_model_meta_takes_the_last(spark, tmp_path):
    for n, layers in ((1, 10), (2, 14)):
        (tmp_path / f"meta_{n:03d}.json").write_text(json.dumps({"model_config": {"n_layer": layers}}))
    assert results.latest_model_meta(spark, str(tmp_path))["model_config"]["n_layer"] == 14
    assert results.latest_model_meta(spark, str(tmp_path / "none")) is None


def test_fixed_size_shards_end_with_a_validation_shard(spark, tmp_path):
    docs = spark.createDataFrame([(i * 5, f"t{i}") for i in range(25)], "doc_id long, text string")
    sinks.write_shards(docs, str(tmp_path / "out"), 10)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert names == [f"name=shard_{i:05d}" for i in range(4)]
    assert spark.read.parquet(str(tmp_path / "out/name=shard_00003")).count() == 1
    assert not sinks.convert_shards(spark, "unused", str(tmp_path / "out"))


def test_blend_has_exact_rows_and_wraps(spark):
    primary = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "doc_id long, text string")
    general = spark.createDataFrame([(10, "g")], "doc_id long, text string")
    rows = blending.blend(primary, general, 200).collect()
    assert len(rows) == 200 and 100 < sum(r["source"] == "primary" for r in rows) < 180
    only = blending.blend(primary, general.limit(0), 7).orderBy("position").collect()
    assert [r["text"] for r in only] == [f"p{i % 3}" for i in range(7)]


def test_pipeline_writes_everything(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text {i}", i % 3, 10, float(i % 5 + 1)) for i in range(120)], "doc_id long, text string, domain int, tokens long, q1 double")
    config = MixtureConfig(discovery=DiscoveryConfig(k_init=9, k_enhanced=3, prune_threshold=1.0), search=SearchConfig(configs_per_iter=[10, 4], pool_per_concentration=100, refine=20))
    config.target_tokens = 600
    run = run_pipeline(texts.drop("text"), ["q1"], config)
    out = str(tmp_path / "out")
    write_run(run, texts, out, config, general=spark.createDataFrame([(0, "g")], "doc_id long, text string"), files=2)
    kept = spark.read.parquet(f"{out}/selected")
    assert set(kept.columns) == {"text", "doc_id", "cluster", "original_cluster"} and kept.count() == run.selected.count()
    assert len(json.loads((tmp_path / "out/weights.json").read_text())) == 3
    assert "centroid_norm" in json.loads((tmp_path / "out/clusters.json").read_text())[0]
    assert results.read_search_state(spark, f"{out}/search.json").weights
    assert "## Clusters" in (tmp_path / "out/report.md").read_text()


def test_stream_takes_in_new_files_once(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    for expected in (7, 7):
        stream = ingest.stream_documents(spark, folder, schema)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
    batch = spark.read.parquet(str(tmp_path / "out"))
    assert ingest.running_tokens(batch, "cat").agg(F.sum("docs")).first()[0] == 7


def test_lookup_of_all_ids_and_beyond(spark, sf_dir):
    from mixweave.plans.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["s8_text_lookup_all"](spark, sf_dir).collect()
    wanted = [r["doc_id"] for r in out]
    assert set(texts) <= set(wanted) and max(wanted) > max(texts) and len(set(wanted)) < len(wanted)
    assert all(r["text"] == texts.get(r["doc_id"], "") for r in out)


def test_blend_of_all_documents(spark, sf_dir):
    from mixweave.plans.queries import QUERIES

    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    out = QUERIES["m1_blend_all"](spark, sf_dir).collect()
    drawn = [r["doc_id"] for r in out if r["source"] == "primary"]
    assert len(out) == 2 * len(ids) and set(drawn) == set(ids) and len(drawn) > len(ids)
