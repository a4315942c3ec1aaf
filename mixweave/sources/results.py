"""What training and evaluation leave behind: CSV tables, logs, model metadata, search state."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import SearchState

# Names of rows in the tables and of labels in the logs of an evaluation.
AGGREGATE, SKIPPED = "STEM", "CORE"
TASK_LABEL, CORE_LABEL = "Evaluating:", "CORE metric:"
FIELDS = ("accuracy", "centered", "time")


def parse_eval_csv(lines: DataFrame, line: str = "value") -> DataFrame:
    """(task, acc, nll, is_aggregate, and lines' other columns) from lines "task, accuracy, centered,
    nll": at least three fields; the centered accuracy counts, and a missing or unreadable loss is 0.
    Tasks without a readable accuracy are left out; an aggregate keeps its loss without one."""
    fields = F.split(F.col(line), ",")
    part = lambda i: F.trim(F.get(fields, F.lit(i)))
    others = [c for c in lines.columns if c != line]
    rows = lines.where(F.size(fields) >= 3).select(*others, part(0).alias("task"), part(2).try_cast("double").alias("acc"), F.coalesce(part(3).try_cast("double"), F.lit(0.0)).alias("nll"))
    rows = rows.withColumn("is_aggregate", F.col("task") == AGGREGATE)
    return rows.where((F.col("acc").isNotNull() | F.col("is_aggregate")) & (F.col("task") != SKIPPED))


def aggregate_metrics(rows: DataFrame, by: str, val_tasks: Sequence[str] | None = None, order: str = "line_no") -> DataFrame:
    """(by, acc, nll): a run's aggregate row; without one, the mean of its validation tasks (of all,
    if none are named), and the mean of their losses also where the aggregate's is 0. Of rows that
    repeat a task the last counts, as it does of an aggregate's accuracies and of its losses."""
    last = rows.groupBy(by, "task", "is_aggregate").agg(F.max_by("acc", F.when(F.col("acc").isNotNull(), F.col(order))).alias("acc"), F.max_by("nll", order).alias("nll"))
    whole, tasks = F.col("is_aggregate"), ~F.col("is_aggregate")
    if val_tasks is not None:
        tasks = tasks & F.col("task").isin(*val_tasks)
    own = last.groupBy(by).agg(F.max(F.when(whole, F.col("acc"))).alias("a"), F.max(F.when(whole, F.col("nll"))).alias("n"), F.avg(F.when(tasks, F.col("acc"))).alias("ta"), F.avg(F.when(tasks, F.col("nll"))).alias("tn"))
    return own.select(by, F.coalesce("a", "ta", F.lit(0.0)).alias("acc"), F.when(F.coalesce("n", F.lit(0.0)) != 0, F.col("n")).otherwise(F.coalesce("tn", F.lit(0.0))).alias("nll"))


def _after(text: Column, label: str) -> Column:
    """What follows the last occurrence of a label; null without it."""
    return F.when(F.contains(text, F.lit(label)), F.trim(F.substring_index(text, label, -1)))


def parse_eval_log(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """(task, accuracy, centered, time, line_no): the last report of each task; the core metric comes
    as a task of that name with its value as accuracy.

    A report names its task, something in parentheses, and fields "name: value" with bars between.
    """
    report = _after(F.col(line), TASK_LABEL)
    named = F.transform(F.split(F.substring_index(report, "...", -1), "[|]"), lambda f: F.struct(F.trim(F.substring_index(f, ":", 1)).alias("name"), F.rtrim(F.trim(F.substring_index(f, ":", -1)), F.lit("s")).try_cast("double").alias("value")))
    value = lambda name: F.get(F.filter(named, lambda f: f["name"] == name), F.lit(0))["value"]
    tasks = lines.select(number, F.trim(F.substring_index(report, "(", 1)).alias("task"), *[value(n).alias(n) for n in FIELDS]).dropna(subset=["task", *FIELDS])
    none = F.lit(None).cast("double")
    core = F.get(F.split(_after(F.col(line), CORE_LABEL), r"\s"), F.lit(0)).try_cast("double")
    cores = lines.select(number, F.lit("CORE metric").alias("task"), core.alias("accuracy"), none.alias("centered"), none.alias("time")).dropna(subset=["accuracy"])
    last = F.max_by(F.struct(*FIELDS, number), number).alias("last")
    return tasks.unionByName(cores).groupBy("task").agg(last).select("task", *[f"last.{n}" for n in FIELDS], f"last.{number}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): the lines of text files, numbered in order within each file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def latest_model_meta(spark: SparkSession, folder: str) -> dict | None:
    """The last meta_*.json of a folder by name."""
    from .shards import list_files

    try:
        names = [n for n, _, _ in list_files(spark, folder, "meta_*.json")]
    except FileNotFoundError:
        return None
    return json.loads(read_text(spark, f"{folder}/{names[-1]}"))


def read_search_state(spark: SparkSession, path: str) -> SearchState:
    return SearchState.from_json(read_text(spark, path))


def core_metric(text: str) -> float | None:
    """The last core metric that a log states."""
    for piece in reversed(text.split(CORE_LABEL)[1:]):
        try:
            return float(piece.split(maxsplit=1)[0])
        except (IndexError, ValueError):
            continue
    return None
