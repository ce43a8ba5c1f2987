"""The tables behind charts; drawing is left to others."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.functions.scoring import correlation, r_squared
from gatherline.operators import inference
from gatherline.operators.blocks import running
from gatherline.operators.runs import KWH_PER_SECOND, LOG_ORDER, metric_value, metric_values, successful
from gatherline.sources.scratch import written


def delay_r2(scores: DataFrame, group=("series_id",), threshold: float | None = None) -> DataFrame:
    out = scores.groupBy(*group, "k").agg(r_squared(F.col("p"), F.col("y")).alias("r2"))
    return out if threshold is None else out.withColumn("above", F.col("r2") >= threshold)


def delay_heatmap(scores: DataFrame, delay_max: int, group=("series_id",)) -> DataFrame:
    """A row for each group, a column of r2 for each delay."""
    at = lambda k, c: F.when(F.col("k") == k, F.col(c))
    return scores.groupBy(*group).agg(*[r_squared(at(k, "p"), at(k, "y")).alias(f"k{k}") for k in range(delay_max + 1)])


def method_scores(runs: DataFrame, group=("experiment_id",)) -> DataFrame:
    rows = successful(runs).withColumn("value", metric_value()).where("value IS NOT NULL")
    return rows.groupBy(*group, "task_name", "primary_metric_name").agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))


def stage_seconds(runs: DataFrame, stages: str = "stages", group=("experiment_id",)) -> DataFrame:
    return runs.select(*group, F.explode(stages).alias("stage", "seconds")).groupBy(*group, "stage").agg(F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "PASS", 1).when(verdict == "FAIL", -1).otherwise(0)


def metric_correlation(rows: DataFrame, names: list[str]) -> DataFrame:
    """``a, b, r`` of all pairs of metrics, in one pass."""
    if len(names) < 2:
        raise ValueError("a correlation matrix needs two metrics")
    pairs = list(combinations_with_replacement(names, 2))
    one = rows.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def headline(runs: DataFrame, metric: str, control: str, group=("experiment_id",), resamples: int = 1000) -> DataFrame:
    """A row for each group and system, a task with the metric: ``*group, system, n, mean, low, high, paired_delta, holm_p``.

    ``low`` and ``high`` are the bootstrap interval of the mean. Values are paired by their place in the log with the
    control's; ``paired_delta`` is the mean difference, ``holm_p`` the paired test's two-sided p, corrected over all rows of the
    table; both are null for the control itself, and the p where fewer than three pairs or equal differences give none.
    """
    keys = [*group, "system"]
    values = metric_values(successful(runs), metric).withColumn("system", F.col("task_name"))
    values = written(running(values, keys, LOG_ORDER, before="place").select(*keys, "place", F.col("value").cast("double").alias("x")))
    ci = inference.bootstrap_ci(values, keys, order="place", resamples=resamples)
    means = values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    other = values.where(F.col("system") == control).select(*group, "place", F.col("x").alias("b"))
    pairs = values.where(F.col("system") != control).withColumnRenamed("x", "a").join(other, [*group, "place"])
    tests = inference.paired(pairs, keys).select(*keys, F.col("mean_diff").alias("paired_delta"), F.when((F.col("n") > 2) & ~F.isnan("p"), F.col("p")).alias("p"), F.lit(1).alias("family"))
    adjusted = inference.holm(tests.where("p IS NOT NULL")).select(*keys, F.col("adjusted").alias("holm_p"))
    return means.join(ci, keys).join(tests.select(*keys, "paired_delta"), keys, "left").join(adjusted, keys, "left")


def compute_table(runs: DataFrame, seconds: Column, group=("experiment_id",)) -> DataFrame:
    """``*group, task_name, n, cell_seconds, mean_seconds, group_seconds, group_kwh``: compute of each cell and of its group."""
    cells = runs.withColumn("_s", F.coalesce(seconds, F.lit(0.0))).groupBy(*group, "task_name").agg(F.count("*").alias("n"), F.sum("_s").alias("cell_seconds"), F.avg("_s").alias("mean_seconds"))
    whole = cells.groupBy(*group).agg(F.sum("cell_seconds").alias("group_seconds")).withColumn("group_kwh", F.col("group_seconds") * KWH_PER_SECOND)
    return cells.join(whole, list(group))
