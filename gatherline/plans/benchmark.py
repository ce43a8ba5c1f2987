"""The benchmark pipeline: targets, features, split, fit, score and log rows, for all series in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherline.functions import scoring
from gatherline.operators import features, readout, series
from gatherline.sources.scratch import written

#: Task to metric.
METRICS = {"stm": "mc", "parity": "accuracy", "narma": "nrmse"}


def targets(rows: DataFrame, task: str, delay_max: int = 5, width: int = 3) -> DataFrame:
    """``series_id, t, v, y ARRAY<DOUBLE>``: the input that features see, and the task's targets."""
    if task == "stm":
        lags = series.lag_matrix(rows, delay_max)
        return lags.select("series_id", "t", F.col("u").alias("v"), F.array(*[f"y_{k}" for k in range(delay_max + 1)]).alias("y"))
    if task == "parity":
        return series.rolling_parity(rows, width).select("series_id", "t", F.col("b").cast("double").alias("v"), F.array(F.col("y").cast("double")).alias("y"))
    return series.narma_recurrence(rows).select("series_id", "t", F.col("u").alias("v"), F.array("y").alias("y"))


def fitted_scores(rows: DataFrame, train_frac: float = 0.7, folds: int = 3, alphas=readout.ALPHAS) -> tuple[DataFrame, DataFrame]:
    """``series_id, t, k, p, y`` on the test rows of ``rows(series_id, t, x, y ARRAY)``: split, blocked CV, ridge; and
    ``series_id, reason`` of the series whose fit failed. Fits are written once and serve both."""
    split = series.chrono_split(rows, train_frac)
    train = series.fold_ids(split.where("is_train"), folds)
    fits = written(readout.fits(train.select("series_id", "fold", "x", "y"), alphas))
    return readout.predict(split.where("NOT is_train"), fits.where("success")), fits.where("NOT success").select("series_id", F.col("failure_reason").alias("reason"))


def score(predictions: DataFrame, task: str) -> DataFrame:
    """``series_id, value``: the task's metric of each series; null where a prediction is missing or not finite."""
    p, y = F.col("p"), F.col("y")
    whole = F.count_if(~F.coalesce(scoring.is_finite(p), F.lit(False))) == 0
    if task == "stm":
        each = predictions.groupBy("series_id", "k").agg(F.when(whole, scoring.r_squared(p, y, guarded=False)).alias("r2"))
        return each.groupBy("series_id").agg(F.when(F.count("r2") == F.count("*"), F.sum("r2")).alias("value"))
    metric = scoring.accuracy(p, y, guarded=False) if task == "parity" else scoring.nrmse(p, y, guarded=False)
    return predictions.groupBy("series_id").agg(F.when(whole, metric).alias("value"))


def log_rows(scores: DataFrame, faulty: DataFrame, task: str, label: str | None = None, task_seed: int = 42, reservoir_seed: int = 137) -> DataFrame:
    """Run-log rows; a score that is missing or not finite is a failed run, and so is a faulty series, with its own reason."""
    scores = scores.select("series_id", "value", F.lit(None).cast("string").alias("reason")).unionByName(faulty.select("series_id", F.lit(None).cast("double").alias("value"), "reason"))
    ok = F.coalesce(scoring.is_finite(F.col("value")), F.lit(False))
    return scores.select(
        F.concat_ws("-", F.lit(label or task), F.col("series_id").cast("string")).alias("run_id"), F.col("series_id").alias("experiment_id"), F.lit(label or task).alias("task_name"), F.lit(METRICS[task]).alias("primary_metric_name"),
        F.col("value").alias("primary_metric_value"), F.lit(task_seed).cast("bigint").alias("task_seed"), F.lit(reservoir_seed).cast("bigint").alias("reservoir_seed"), ok.alias("success"), F.when(~ok, F.coalesce("reason", F.lit("score is not finite"))).alias("failure_reason"),
    )


def split_faulty(rows: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the series that the task can use, and ``series_id, reason`` of the others, which become failed runs."""
    u = F.col({"narma": "u01", "parity": "b"}.get(task, "u")).cast("double")
    fault = F.when(~F.coalesce(scoring.is_finite(u), F.lit(False)), "input is not finite")
    if task == "narma":
        fault = fault.when((u < 0) | (u > 0.5), "input outside [0, 0.5]")
    marked = rows.withColumn("_fault", F.min(fault).over(Window.partitionBy("series_id")))
    faulty = marked.where("_fault IS NOT NULL").select("series_id", F.col("_fault").alias("reason")).distinct()
    return marked.where("_fault IS NULL").drop("_fault"), faulty


def run_task(rows: DataFrame, task: str, n_features: int | DataFrame = 8, sigma: float = 1.0, control: str | None = None, seed: int = 137) -> DataFrame:
    """One task on cosine features; ``control`` is ``random_features`` (as they are) or ``phase_random`` (drawn per row).

    ``n_features``: their number, or the competing feature table that it is to match.
    """
    if isinstance(n_features, DataFrame):
        n_features = features.matched_count(n_features)
    rows, faulty = split_faulty(rows, task)
    made = targets(rows, task)
    if control == "phase_random":
        x = features.cosine_features_per_row(made, n_features, sigma * n_features, seed, "v")
    else:
        x = features.cosine_features(made, features.cosine_params(rows.sparkSession, n_features, sigma * n_features, seed), "v")
    predictions, unfitted = fitted_scores(x)
    return log_rows(score(predictions, task), faulty.unionByName(unfitted), task, f"ablation:{control}" if control else None, reservoir_seed=seed)


def run_leaky(rows: DataFrame, task: str = "narma", label: str = "esn_narma", grid: DataFrame | None = None) -> DataFrame:
    """The leaky-state baseline: grid search, refit of the best, score and log rows."""
    rows, faulty = split_faulty(rows, task)
    made = targets(rows, task).select("series_id", "t", F.col("v").alias("u"), F.get("y", F.lit(0)).alias("y"))
    train = series.chrono_split(made, 0.7).where("is_train").drop("is_train")
    best = written(readout.best_config(readout.grid_search(train, grid), strict=False))
    unfitted = best.where(F.col("score") == float("inf")).select("series_id", F.lit("no configuration could be fitted").alias("reason"))
    refit = readout.refit_best(made, best.where(F.col("score") < float("inf")).drop("score"), capture=True)
    predictions, broken = series.failed(refit, ("series_id",))
    return log_rows(score(predictions.withColumn("k", F.lit(0)), task), faulty.unionByName(unfitted).unionByName(broken), task, label)
