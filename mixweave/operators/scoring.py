"""Scores of mixtures from proxy results, weighted by each benchmark's signal to noise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.models import BENCHMARK_SIZES, DEFAULT_BENCHMARK_SIZE

EPSILON = 1e-12


def densify(results: DataFrame, configs: DataFrame, benchmarks: Sequence[str], drop_failed: bool = False) -> DataFrame:
    """A row for each configuration and benchmark; what is missing is 0, or left out if dropped."""
    spark = results.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in benchmarks])).alias("benchmark"))
    if drop_failed:
        configs = configs.join(results.select("config_id").distinct(), "config_id", "left_semi")
    grid = configs.select("config_id").crossJoin(F.broadcast(names))  # benchmarks are a declared list
    return grid.join(results, ["config_id", "benchmark"], "left").select("config_id", "benchmark", F.coalesce("acc", F.lit(0.0)).alias("acc"), F.coalesce("nll", F.lit(0.0)).alias("nll"))


def signal_weight(variance: Column, size: Column, floor: float) -> Column:
    """How far accuracy counts against likelihood: the part of its variance that isn't noise."""
    f = 1 - (F.lit(0.25) / size) / (variance + EPSILON)
    return F.greatest(F.lit(float(floor)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + f) / 2)))


def benchmark_scores(dense: DataFrame, sizes: Mapping[str, int] = BENCHMARK_SIZES, w_floor: float = 0.0) -> DataFrame:
    """config_id, benchmark, w, acc_z, nll_z: deviations across configurations, likelihood negated."""
    across = W.partitionBy("benchmark")
    z = lambda c: (F.col(c) - F.avg(c).over(across)) / (F.stddev_pop(c).over(across) + EPSILON)
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("benchmark")), F.lit(DEFAULT_BENCHMARK_SIZE)) if sizes else F.lit(DEFAULT_BENCHMARK_SIZE)
    return dense.select("config_id", "benchmark", signal_weight(F.var_pop("acc").over(across), size, w_floor).alias("w"), z("acc").alias("acc_z"), (-z("nll")).alias("nll_z"))


def mixture_scores(results: DataFrame, configs: DataFrame, benchmarks: Sequence[str], sizes: Mapping[str, int] = BENCHMARK_SIZES, w_floor: float = 0.0, drop_failed: bool = False) -> DataFrame:
    """(config_id, score), higher is better."""
    parts = benchmark_scores(densify(results, configs, benchmarks, drop_failed), sizes, w_floor)
    return parts.groupBy("config_id").agg((F.sum(F.col("w") * F.col("acc_z") + (1 - F.col("w")) * F.col("nll_z")) / len(benchmarks)).alias("score"))


def spread(results: DataFrame) -> DataFrame:
    """(benchmark, mean, deviation, variance, best) of accuracies; best is the first configuration with the highest."""
    best = F.max(F.struct("acc", (-F.col("config_id")).alias("first")))["first"]
    return results.groupBy("benchmark").agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("deviation"), F.var_pop("acc").alias("variance"), (-best).alias("best"))


def r2_score(rows: DataFrame, target: str, predicted: str) -> DataFrame:
    sums = rows.agg(F.sum((F.col(target) - F.col(predicted)) ** 2).alias("sse"), (F.var_pop(target) * F.count("*")).alias("sst"))
    return sums.select((1 - F.col("sse") / F.col("sst")).alias("r2"))
