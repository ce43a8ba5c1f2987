"""Run-log operators: filters, metric extraction, pairings, summaries, totals and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.operators.blocks import running

LOG_ORDER = ("timestamp_utc", "run_id")
KWH_PER_SECOND = 15 / 3.6e6


def succeeded(success: str = "success") -> Column:
    """True for the encodings that logs hold: a boolean, or ``true`` in any case."""
    return F.lower(F.col(success).cast("string")) == "true"


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(succeeded())


def of_task(runs: DataFrame, task: str) -> DataFrame:
    """Rows of one task; none if the log lacks the column."""
    return runs.where(F.col("task_name") == task) if "task_name" in runs.columns else runs.where(F.lit(False))


def metric_value(metric: str | None = None) -> Column:
    """The row's metric as a number if it has this name; null where it isn't a number. Infinities stay."""
    v = F.col("primary_metric_value").try_cast("double")
    v = F.when(~F.isnan(v), v)
    return v if metric is None else F.when(F.col("primary_metric_name") == metric, v)


def metric_values(runs: DataFrame, metric: str) -> DataFrame:
    return runs.withColumn("value", metric_value(metric)).where("value IS NOT NULL")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' JSON, sorted by name: equal configurations have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def passed_gate(gates_passed: str, gate: str) -> Column:
    """Does a JSON list of gates hold this one?"""
    return F.coalesce(F.array_contains(F.from_json(gates_passed, "array<string>"), gate), F.lit(False))


def passed_gate_like(gates_passed: str, gate: str) -> Column:
    return F.col(gates_passed).like(f'%"{gate}"%')


def newest_first(runs: DataFrame, task: str, only_successful: bool = False) -> DataFrame:
    rows = of_task(runs, task)
    return (successful(rows) if only_successful else rows).orderBy(F.desc("timestamp_utc"), "run_id")


def task_means(runs: DataFrame, group=("experiment_id",)) -> DataFrame:
    rows = successful(runs).withColumn("value", metric_value())
    return rows.where("value IS NOT NULL").groupBy(*group, "task_name", "primary_metric_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def run_summary(runs: DataFrame, group=("experiment_id",)) -> DataFrame:
    good = F.count_if(succeeded())
    return runs.groupBy(*group).agg(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"))


def stage_total(stages: str = "stages") -> Column:
    """Seconds of all stages; null for an empty or missing map."""
    return F.when(F.size(stages) > 0, F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, x: a + x))


def timing_summary(samples: DataFrame, name: str = "name", seconds: str = "seconds") -> DataFrame:
    s = F.col(seconds)
    return samples.groupBy(name).agg(F.count(s).alias("iterations"), F.sum(s).alias("total_seconds"), F.avg(s).alias("mean_seconds"), F.min(s).alias("min_seconds"), F.max(s).alias("max_seconds"))


def compute_totals(runs: DataFrame, seconds: Column, group=("experiment_id",)) -> DataFrame:
    """Runs, seconds, energy at 15 W and last update of each group."""
    total = F.coalesce(F.sum(seconds), F.lit(0.0))
    return runs.groupBy(*group).agg(F.count("*").alias("total_runs"), total.alias("total_seconds"), (total * KWH_PER_SECOND).alias("kwh"), F.max("timestamp_utc").alias("last_update"))


def running_totals(runs: DataFrame, seconds: Column, group=("experiment_id",)) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*LOG_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumns({"runs_so_far": F.count("*").over(w), "seconds_so_far": F.sum(F.coalesce(seconds, F.lit(0.0))).over(w)})


def distinct_backends(runs: DataFrame, group=("experiment_id",)) -> DataFrame:
    return successful(runs).groupBy(*group).agg(F.array_sort(F.collect_set("backend_device")).alias("backends"), F.count_distinct("circuit_hash").alias("hashes"))


def backend_spread(runs: DataFrame, task: str = "stm", metric: str = "mc", group=("experiment_id",)) -> DataFrame:
    """Backends of a task, and the largest less the smallest of their mean metrics."""
    means = metric_values(of_task(successful(runs), task), metric).groupBy(*group, "backend_device").agg(F.avg("value").alias("mean_value"))
    return means.groupBy(*group).agg(F.count("*").alias("backends"), (F.max("mean_value") - F.min("mean_value")).alias("spread"))


def evidence_ids(runs: DataFrame, treatment: str, control: str) -> DataFrame:
    """``experiment_id, role, run_id``: all successful rows of both tasks, whatever their metric."""
    rows = successful(runs)
    return of_task(rows, treatment).select("experiment_id", F.lit("treatment").alias("role"), "run_id").unionAll(of_task(rows, control).select("experiment_id", F.lit("control").alias("role"), "run_id"))


def pair_by_position(runs: DataFrame, treatment: str, control: str, metric: str, group=("experiment_id",)) -> DataFrame:
    """``a, b``: the i-th values of both tasks in log order; the longer list's rest is left out."""
    placed = lambda task: running(metric_values(of_task(successful(runs), task), metric), group, LOG_ORDER)
    side = lambda task, name: placed(task).select(*group, (F.col("_before") + 1).alias("pair_id"), F.col("value").alias(name))
    return side(treatment, "a").join(side(control, "b"), [*group, "pair_id"])


def pair_by_key(runs: DataFrame, treatment: str, control: str, metric: str, keys=("experiment_id", "task_seed", "reservoir_seed")) -> DataFrame:
    """``a, b``: values of both tasks with equal seeds."""
    side = lambda task, name: metric_values(of_task(successful(runs), task), metric).select(*keys, F.col("value").alias(name))
    return side(treatment, "a").join(side(control, "b"), list(keys))


def seed_runs(configs: DataFrame, n_seeds: int, task_seed: str = "task_seed", reservoir_seed: str = "reservoir_seed") -> DataFrame:
    """Each configuration ``n_seeds`` times, both seeds counted up."""
    return configs.withColumn("seed_index", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1)))).withColumns({c: F.col(c) + F.col("seed_index") for c in (task_seed, reservoir_seed)})


def grid(spark, **values) -> DataFrame:
    """All combinations of the values, the last one running fastest, with their place in the grid."""
    out = spark.range(0, 1, 1, 1).select()
    for n, vs in values.items():
        out = out.select("*", F.posexplode(F.lit([float(v) for v in vs])).alias(f"_{n}", n))
    place = reduce(lambda acc, n: acc * len(values[n]) + F.col(f"_{n}"), values, F.lit(0))
    return out.withColumn("grid_pos", place.cast("int")).select(*values, "grid_pos")


def captured(function, schema: str):
    """A grouped function whose failures become rows: ``schema``, which begins with the keys, plus ``success`` and
    ``failure_reason``. Other groups go on."""
    import pandas as pd

    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def safe(key, pdf):
        try:
            out = function(key, pdf).assign(success=True, failure_reason=None)
        except Exception as error:  # noqa: BLE001 - the reason is the result
            out = pd.DataFrame([dict.fromkeys(columns) | dict(zip(columns, key, strict=False)) | {"success": False, "failure_reason": f"{type(error).__name__}: {error}"}])
        return out.reindex(columns=[*columns, "success", "failure_reason"])

    return safe, f"{schema}, success boolean, failure_reason string"


def replacements(runs: DataFrame, group=("experiment_id", "task_name")) -> DataFrame:
    """Failed or non-finite runs, each with the reason and the next unused task seed of its group."""
    v = F.col("primary_metric_value").try_cast("double")
    reason = F.when(~succeeded(), "failed").when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "non-finite")
    top = F.max("task_seed").over(Window.partitionBy(*group))
    bad = runs.withColumn("reason", reason).withColumn("top", top).where("reason IS NOT NULL")
    at = F.row_number().over(Window.partitionBy(*group).orderBy("task_seed", "run_id"))
    return bad.select(*group, "run_id", "task_seed", "reason", (F.col("top") + at).alias("next_seed"))


def matched_baseline(runs: DataFrame, treatment: str, baseline: str, metric: str, within: float = 0.1) -> DataFrame:
    """For each experiment the baseline configuration whose mean metric is nearest the treatment's, within a share of it."""
    rows = metric_values(successful(runs), metric)
    goal = of_task(rows, treatment).groupBy("experiment_id").agg(F.avg("value").alias("target"))
    means = of_task(rows, baseline).groupBy("experiment_id", "config_hash").agg(F.avg("value").alias("mean_value"))
    gap = F.abs(F.col("mean_value") - F.col("target"))
    near = means.join(goal, "experiment_id").where(gap <= within * F.abs("target"))
    best = near.groupBy("experiment_id").agg(F.min(F.struct(gap.alias("gap"), "config_hash", "mean_value", "target")).alias("m"))
    return best.select("experiment_id", "m.config_hash", "m.mean_value", "m.target")
