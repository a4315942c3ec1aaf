"""What a run writes: the selection, shards of fixed size, JSON summaries and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import l2_norm
from ..operators.blending import batches, with_ordinal

SHARD_ROWS = 10_000


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by Hadoop's file system, so that any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_selected(selected: DataFrame, path: str) -> None:
    selected.select("text", "doc_id", F.col("cluster_id").cast("long").alias("cluster"), F.col("original_cluster_id").cast("long").alias("original_cluster")).write.mode("overwrite").parquet(path)


def plan_shards(docs: DataFrame, rows: int = SHARD_ROWS, order: str = "doc_id") -> DataFrame:
    """docs with `shard` and `split`: files of so many rows in order, and after the last one a
    validation shard that repeats the first hundredth, one document at least."""
    placed = batches(with_ordinal(docs, order), "ordinal", rows).withColumn("split", F.lit("train"))
    n = docs.count()
    if not n:
        return placed
    val = placed.where(F.col("ordinal") < max(1, n // 100)).withColumn("shard", F.lit(-(-n // rows)).cast("int")).withColumn("split", F.lit("val"))
    return placed.unionByName(val)


def write_shards(docs: DataFrame, path: str, rows: int = SHARD_ROWS, order: str = "doc_id") -> None:
    """One folder per shard: a shard is a task, and all are written at once."""
    planned = plan_shards(docs, rows, order)
    name = F.format_string("shard_%05d", "shard")
    out = planned.withColumn("name", name).repartition("name").sortWithinPartitions("name", "ordinal")
    out.select("name", "text").write.mode("overwrite").partitionBy("name").parquet(path)


def convert_shards(spark: SparkSession, source: str, path: str, rows: int = SHARD_ROWS, text: str = "text") -> bool:
    """Deal a collection to shards of fixed size anew; nothing is done where they are already."""
    from .shards import read_shards, with_doc_id

    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    write_shards(with_doc_id(read_shards(spark, source)).select("doc_id", F.col(text).alias("text")), path, rows)
    return True


def cluster_json(info: DataFrame) -> str:
    """The cluster table as JSON, each centroid by its length."""
    rows = info.withColumn("centroid_norm", F.round(l2_norm(F.col("centroid")), 6)).drop("centroid").orderBy("cluster_id")
    return json.dumps([r.asDict() for r in rows.collect()], indent=2)  # a row per cluster


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def weights_json(weights: Sequence[float], labels: Sequence[str]) -> str:
    return json.dumps({label: float(w) for label, w in zip(labels, weights, strict=True)}, indent=2)


def _table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    return ["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *["| " + " | ".join(str(c) for c in r) + " |" for r in rows], ""]


def markdown_report(parameters: dict[str, object], clusters: Sequence[dict], iterations: Sequence[dict], seconds: dict[str, float]) -> str:
    """A run's report from its small tables: a row per cluster, iteration and stage."""
    number = lambda x, form: format(x, form) if x is not None else "N/A"
    lines = ["# Mixture report", "", "## Configuration", "", *_table(("Parameter", "Value"), list(parameters.items()))]
    lines += ["## Clusters", "", *_table(("#", "Label", "Docs (orig)", "Docs (sel)", "Tokens", "Weight", "Ratio"), [(c["cluster_id"], f"C{c['cluster_id']}", f"{c['original_docs']:,}", f"{c['selected_docs']:,}", f"{c['original_tokens']:,}", f"{c['weight']:.4f}", f"{c['ratio']:.2f}") for c in clusters])]
    lines += ["## Iterations", "", *_table(("Iter", "Configs", "Trained", "Best score", "Predictor R2"), [(i["iteration"], i.get("n_configs", "N/A"), i.get("n_trained", "N/A"), number(i.get("best_score"), ".4f"), number(i.get("predictor_r2"), ".4f")) for i in iterations])]
    lines += ["## Stage timing", "", *_table(("Stage", "Time (s)"), [(k, f"{v:.1f}") for k, v in seconds.items()])]
    return "\n".join(lines)


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(task, a, b, delta) of all tasks of two runs (task, accuracy); a 0 counts as no result."""
    a, b = (x.select("task", F.when(F.col("accuracy") != 0, F.col("accuracy")).alias(n)) for x, n in ((first, "a"), (second, "b")))
    return a.join(b, "task", "full_outer").select("task", "a", "b", (F.col("a") - F.col("b")).alias("delta"))


def validation_report(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("Optimal", "Random")) -> str:
    """Two runs' tasks side by side; the core metric has its own table."""
    rows = compare_runs(first, second).orderBy("task").collect()  # a row per task
    show = lambda x, form: "N/A" if x is None else format(x, form)
    line = lambda r: (r["task"], show(r["a"], ".4f"), show(r["b"], ".4f"), show(r["delta"], "+.4f"))
    header = ("Task", f"{names[0]} accuracy", f"{names[1]} accuracy", "Delta")
    core, tasks = [line(r) for r in rows if r["task"] == "CORE metric"], [line(r) for r in rows if r["task"] != "CORE metric"]
    return "\n".join(["# Validation report", "", "## Core metric", "", *_table(header, core), "## Tasks", "", *_table(header, tasks)])


def timing_report(timings: DataFrame) -> DataFrame:
    """(section, total, average, runs) from (section, seconds)."""
    return timings.groupBy("section").agg(F.sum("seconds").alias("total"), F.avg("seconds").alias("average"), F.count("*").alias("runs"))


def shard_index_json(offsets: DataFrame) -> str:
    """The table of files (shard_file, rows, start, end) as JSON, a record per file."""
    return json.dumps([r.asDict() for r in offsets.orderBy("start", "shard_file").collect()], indent=2)
