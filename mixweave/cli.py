"""Command line: python -m mixweave.cli --data-dir DIR --schema FILE.yaml [options].

Without a trainer (--train-command) the search runs on made-up results. The command gets the folder of
a configuration's shards, the configuration's id and a result file as its last arguments; it writes
lines "task, accuracy, centered accuracy, loss" to that file.
"""

from __future__ import annotations

import argparse
import shlex
import subprocess
import tempfile
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DiscoveryConfig, FilterConfig, MixtureConfig, ModelConfig, SearchConfig
from .functions.models import BENCHMARK_SIZES
from .operators.discovery import DISCOVERIES, code_domains
from .operators.filters import FILTERS
from .operators.search import Metrics, SearchState
from .plans.experiments import MixtureExperiments
from .plans.pipeline import run_pipeline, write_run
from .schema import DatasetSchema
from .sources.results import parse_eval_csv, read_search_state
from .sources.shards import fingerprint, read_general, read_shards, scan_metadata, with_doc_id
from .sources.sinks import exists, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mixweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    add = p.add_argument
    add("--data-dir", required=True, help="folder of parquet shards")
    add("--schema", required=True, help="YAML file that declares the columns")
    add("--output-dir", default="./mixweave_output")
    add("--general-data-dir", default="", help="folder of general shards to blend with")
    add("--primary-ratio", type=float, default=0.7, help="share of selected documents in a blend")
    add("--discovery-method", default="embedding_cluster", choices=sorted(DISCOVERIES))
    add("--k-init", type=int, default=1000)
    add("--k-enhanced", type=int, default=10)
    add("--embedding-sample-size", type=int, default=0, help="documents to embed; 0 takes all")
    add("--prune-threshold", type=float, default=None, help="default: the schema's")
    add("--cluster-measure", default="cosine", choices=["cosine", "euclidean"])
    add("--merge-distance", type=float, default=1.5)
    add("--filter-method", default="none", choices=sorted(FILTERS))
    for name, depth in (("proxy", 20), ("target", 28)):
        add(f"--{name}-depth", type=int, default=depth)
        add(f"--{name}-num-iterations", type=int, default=None)
        add(f"--{name}-ratio", type=float, default=None)
        add(f"--{name}-meta-dir", default=None, help="folder of the model's meta_*.json")
    add("--configs-per-iter", default="15,8,4")
    add("--num-iterations", type=int, default=None, help="default: as many as --configs-per-iter names")
    add("--dirichlet-alpha", type=float, default=None)
    add("--val-tasks", default=",".join(BENCHMARK_SIZES))
    add("--train-command", default="", help="runs an experiment; without it results are made up")
    add("--experiments-at-once", type=int, default=1)
    add("--skip-target", action="store_true")
    add("--cluster-cache-dir", default=None)
    add("--resume-search", action="store_true")
    add("--target-tokens", type=int, default=None)
    add("--files", type=int, default=1, help="shards to write")
    return p


def config_of(args: argparse.Namespace, schema: DatasetSchema) -> MixtureConfig:
    counts = [int(x) for x in args.configs_per_iter.split(",")]
    rounds = args.num_iterations or len(counts)
    counts = [*counts, *[counts[-1]] * rounds][:rounds]
    threshold = schema.prune_threshold if args.prune_threshold is None else args.prune_threshold
    model = lambda name: ModelConfig(getattr(args, f"{name}_depth"), getattr(args, f"{name}_num_iterations"), getattr(args, f"{name}_ratio"), getattr(args, f"{name}_meta_dir"))
    return MixtureConfig(
        discovery=DiscoveryConfig(method=args.discovery_method, k_init=args.k_init, k_enhanced=args.k_enhanced, sample_size=args.embedding_sample_size, prune_threshold=threshold, merge_distance=args.merge_distance, measure=args.cluster_measure),
        filtering=FilterConfig(method=args.filter_method), search=SearchConfig(configs_per_iter=counts, dirichlet_alpha=args.dirichlet_alpha),
        proxy=model("proxy"), target=model("target"), val_tasks=args.val_tasks.split(","), primary_ratio=args.primary_ratio, target_tokens=args.target_tokens,
    )


def trainer(spark: SparkSession, command: str):
    """A command as what runs an experiment; its result file lies on the driver."""

    def train(folder: str, config_id: int, weights: np.ndarray) -> Metrics:
        with tempfile.TemporaryDirectory() as own:
            out = Path(own) / "result.csv"
            subprocess.run([*shlex.split(command), folder, str(config_id), str(out)], check=True)
            lines = spark.createDataFrame([(x,) for x in out.read_text().splitlines()], "value string")
        rows = [r for r in parse_eval_csv(lines).collect() if not r["is_aggregate"]]
        return {r["task"]: r["acc"] for r in rows}, {r["task"]: r["nll"] for r in rows}

    return train


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("mixweave").getOrCreate()
    schema = DatasetSchema.from_yaml(args.schema)
    config = config_of(args, schema)
    shards = with_doc_id(read_shards(spark, args.data_dir, schema.pattern))
    texts = shards.select("doc_id", F.col(schema.text_col).alias("text"))
    docs = code_domains(scan_metadata(shards, schema), schema.domain_col, schema.domain_names)
    if args.discovery_method.startswith("embedding"):
        docs = docs.join(texts, "doc_id")
    state_path = f"{args.output_dir}/search.json"
    state = read_search_state(spark, state_path) if args.resume_search and exists(spark, state_path) else None

    def save(found: SearchState) -> None:
        write_text(spark, state_path, found.to_json())

    general = None
    if args.general_data_dir and args.primary_ratio < 1:
        general = with_doc_id(read_general(spark, args.general_data_dir, shards.count(), args.primary_ratio))
        general = general.select("doc_id", F.col(schema.text_col if schema.text_col in general.columns else "text").alias("text"))
    experiments = MixtureExperiments(docs, texts, config, args.output_dir, trainer(spark, args.train_command), general, args.files, args.experiments_at_once) if args.train_command else None
    key = fingerprint(spark, args.data_dir, schema.pattern, schema) if args.cluster_cache_dir else ""
    run = run_pipeline(docs, schema.quality, config, state=state, save=save, cache_dir=args.cluster_cache_dir, cache_key=key, experiments=experiments, target=not args.skip_target)
    write_run(run, texts, args.output_dir, config, general, args.files)
    run.release()


if __name__ == "__main__":
    main()
