"""Decision rules over a run log: every experiment's verdicts from one aggregation pass.

A verdict is PASS, FAIL or INSUFFICIENT_EVIDENCE. Counts and means take successful rows of a task and metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.operators import inference
from gatherline.operators.runs import LOG_ORDER, backend_spread, metric_value, of_task, pair_by_position, succeeded, successful
from gatherline.sources.scratch import written

PASS, FAIL, LITTLE = "PASS", "FAIL", "INSUFFICIENT_EVIDENCE"
#: The sides that the rules compare: name, task and metric.
SIDES = {
    "stm": ("stm", "mc"), "plain": ("ablation:no_entangle", "mc"), "haar": ("ablation:haar", "mc"), "phase": ("ablation:phase_random", "mc"), "esn": ("esn", "mc"),
    "parity": ("parity", "accuracy"), "random": ("ablation:random_features", "accuracy"), "narma": ("narma", "nrmse"), "esn_narma": ("esn_narma", "nrmse"),
}


def moments(runs: DataFrame, group=("experiment_id",)) -> DataFrame:
    """For each side ``n_, mean_, var_`` (divisor max(n - 1, 1)), in one pass."""
    aggs = []
    for name, (task, metric) in SIDES.items():
        v = F.when(succeeded() & (F.col("task_name") == task), metric_value(metric))
        aggs += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.coalesce(F.var_samp(v), F.when(F.count(v) > 0, 0.0)).alias(f"var_{name}")]
    return runs.groupBy(*group).agg(*aggs)


def verdict(enough: Column, passes: Column) -> Column:
    return F.when(~F.coalesce(enough, F.lit(False)), LITTLE).when(passes, PASS).otherwise(FAIL)


def _m(name: str, of: str = "mean") -> Column:
    return F.col(f"{of}_{name}")


def margin() -> Column:
    return F.when(_m("plain") > 0, (_m("stm") - _m("plain")) / _m("plain")).otherwise(0.0)


def pooled_se(a: str, b: str) -> Column:
    return F.sqrt(F.try_divide(_m(a, "var"), _m(a, "n")) + F.try_divide(_m(b, "var"), _m(b, "n")))


def g1(capacity: float = 1.0, least_margin: float = 0.20) -> Column:
    return verdict((_m("stm", "n") >= 5) & (_m("plain", "n") >= 1), (_m("stm") > capacity) & (margin() >= least_margin))


def g2(accuracy: float = 0.70, control: float = 0.60) -> Column:
    return verdict((_m("parity", "n") >= 5) & (_m("random", "n") >= 1), (_m("parity") > accuracy) & (_m("random") < control))


def g25(effect_se: float = 1.0) -> Column:
    se = pooled_se("stm", "haar")
    return verdict((_m("stm", "n") >= 3) & (_m("haar", "n") >= 3) & (se > 0), _m("stm") - _m("haar") >= effect_se * se)


def g4(rule: str = "code") -> Column:
    """``code``: lower error than the echo-state baseline. ``spec``: error under 0.60 and within twice the baseline's."""
    passes = _m("narma") < _m("esn_narma") if rule == "code" else (_m("narma") < 0.60) & (_m("narma") <= 2 * _m("esn_narma"))
    return verdict((_m("narma", "n") >= 5) & (_m("esn_narma", "n") >= 5), passes)


def g8() -> Column:
    """True where a control comes within one standard error of the main system."""
    near = lambda c: F.coalesce((_m(c, "n") > 0) & (_m("stm", "n") > 0) & (F.abs(_m("stm") - _m(c)) <= pooled_se("stm", c)), F.lit(False))
    return near("plain") | near("phase") | near("haar")


def gate_g3(runs: DataFrame) -> DataFrame:
    """``experiment_id, gate, verdict, pairs, adjusted_p, reason``: paired one-sided test by log position, Holm over one."""
    pairs = pair_by_position(runs, "stm", "esn", "mc").withColumnRenamed("experiment_id", "grp")
    test = inference.paired(pairs).select(F.col("grp").alias("experiment_id"), "n", inference.one_sided(F.col("mean_diff"), F.col("p")).alias("p"))
    out = moments(runs).join(test, "experiment_id", "left")
    broken = F.col("p").isNull() | F.isnan("p")
    enough = (_m("stm", "n") >= 5) & (_m("esn", "n") >= 5)
    adjusted = F.least(F.lit(1.0), F.col("p"))
    return out.select("experiment_id", F.lit("G3").alias("gate"), verdict(enough & ~broken, (_m("stm") > _m("esn")) & (adjusted < 0.05)).alias("verdict"), F.col("n").alias("pairs"), adjusted.alias("adjusted_p"), F.when(~enough, "fewer than 5 runs").when(broken, "constant differences").alias("reason"))


def gate_g5(runs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Backends agree to ``tolerance``; with one backend, all its successful rows have one circuit hash."""
    spread = backend_spread(runs)
    only = of_task(successful(runs), "stm").withColumn("v", metric_value("mc")).where("v IS NOT NULL").groupBy("experiment_id").agg(F.min("backend_device").alias("backend_device"))
    hashes = successful(runs).join(only, ["experiment_id", "backend_device"]).groupBy("experiment_id").agg(F.count_distinct("circuit_hash").alias("hashes"))
    every = runs.select("experiment_id").distinct()
    out = every.join(spread, "experiment_id", "left").join(hashes, "experiment_id", "left")
    passes = F.when(F.col("backends") >= 2, F.col("spread") <= tolerance).otherwise(F.col("hashes") == 1)
    return out.select("experiment_id", F.lit("G5").alias("gate"), verdict(F.col("backends") >= 1, passes).alias("verdict"), "backends", "spread", "hashes")


def gate_g0(latest_report: DataFrame) -> DataFrame:
    """From the latest health report ``(overall)``, at most one row: PASS only if it says so; none is too little."""
    return latest_report.agg(F.count("*").alias("n"), F.max("overall").alias("overall")).select(F.lit("G0").alias("gate"), F.when(F.col("n") == 0, LITTLE).when(F.col("overall") == "PASS", PASS).otherwise(FAIL).alias("verdict"))


def gate_g05(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Two feature tables ``(series_id, t, j, x)`` agree in every entry."""
    from gatherline.operators.quality import table_diff

    d = table_diff(left, right, tolerance).agg(F.count("*").alias("n"), F.sum("beyond").alias("beyond"), F.sum("unmatched").alias("unmatched"))
    return d.select(F.lit("G0.5").alias("gate"), verdict(F.col("n") > 0, (F.col("beyond") == 0) & (F.col("unmatched") == 0)).alias("verdict"))


REQUIRED = ("backend", "readout_error", "t1", "t2", "timestamp_utc")


def calibration_faults(files: DataFrame, as_of: Column, max_age_days: float = 30) -> DataFrame:
    """``path, fault``: the first rule that a calibration file ``(path, text)`` breaks, or null.

    In order: JSON object, required keys, timestamp (without offset: UTC), age, numbers, positive times, error share.
    """
    keys = F.json_object_keys("text")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
    raw = lambda k: F.get_json_object("text", f"$.{k}")
    number = lambda k: raw(k).try_cast("double")
    at = F.try_to_timestamp(raw("timestamp_utc"))
    age = (F.unix_micros(as_of) - F.unix_micros(at)) / 86400e6
    rows = files.withColumns({"keys": keys, "missing": missing, "at": at, "age": age, "t1": number("t1"), "t2": number("t2"), "err": number("readout_error")})
    fault = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
        .when(F.col("at").isNull(), "bad timestamp")
        .when(F.col("age") > max_age_days, "too old")
        .when(F.col("t1").isNull() | F.col("t2").isNull() | F.col("err").isNull(), "not a number")
        .when((F.col("t1") <= 0) | (F.col("t2") <= 0), "times must be positive")
        .when(~F.col("err").between(0, 1), "readout error outside [0, 1]")
    )
    return rows.select("path", fault.alias("fault"))


def gate_g7(files: DataFrame, as_of: Column, max_age_days: float = 30) -> DataFrame:
    out = calibration_faults(files, as_of, max_age_days).agg(F.count("*").alias("n"), F.count("fault").alias("faults"))
    return out.select(F.lit("G7").alias("gate"), verdict(F.col("n") > 0, F.col("faults") == 0).alias("verdict"), "n", "faults")


def all_gates(runs: DataFrame) -> DataFrame:
    """``experiment_id, gate, verdict`` of G1, G2, G2.5, G3, G4 and G5; the four moment gates share one pass."""
    rows = {"G1": g1(), "G2": g2(), "G2.5": g25(), "G4": g4()}
    wide = moments(runs).select("experiment_id", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("verdict")) for k, v in rows.items()])).alias("g"))
    out = wide.select("experiment_id", "g.gate", "g.verdict")
    return out.unionByName(gate_g3(runs).select("experiment_id", "gate", "verdict")).unionByName(gate_g5(runs).select("experiment_id", "gate", "verdict"))


def evaluate(gate: str, runs: DataFrame | None = None, **inputs) -> DataFrame:
    """One gate by its name: its verdict rows. Thresholds and further tables go in by the gate functions' own names.

    The moment gates, G3, G5, G8 and G10 judge ``runs``; G0 takes ``latest_report``, G0.5 ``left`` and ``right``, G7
    ``files`` and ``as_of``. An unknown name raises.
    """
    moment = {"G1": g1, "G2": g2, "G2.5": g25, "G4": g4}
    if gate in moment:
        return moments(runs).select("experiment_id", F.lit(gate).alias("gate"), moment[gate](**inputs).alias("verdict"))
    if gate == "G8":
        return moments(runs).select("experiment_id", F.lit(gate).alias("gate"), g8().alias("self_falsified"))
    whole = {"G0": gate_g0, "G0.5": gate_g05, "G7": gate_g7}
    if gate in whole:
        return whole[gate](**inputs)
    of_runs = {"G3": gate_g3, "G5": gate_g5, "G10": separation}
    if gate not in of_runs:
        raise ValueError(f"unknown gate {gate}")
    return of_runs[gate](runs, **inputs)


def run_ids(runs: DataFrame, treatment: str, control: str) -> DataFrame:
    """``experiment_id, run_ids``: treatment ids, then control ids, each in log order."""
    ids = lambda task: F.transform(F.array_sort(F.collect_list(F.when(F.col("task_name") == task, F.struct(*LOG_ORDER)))), lambda x: x["run_id"])
    return successful(runs).groupBy("experiment_id").agg(F.concat(ids(treatment), ids(control)).alias("run_ids"))


def separation(runs: DataFrame, treatment: str, control: str, metric: str, delta: float, seeds: int = 5, realisations: int = 3, resamples: int = 1000) -> DataFrame:
    """``experiment_id, verdict``: separated only if the paired effect is ``delta`` or more, its BCa interval lies above
    0, Holm-adjusted p over all experiments is under 0.05, and enough seeds and realisations were run."""
    pairs = written(pair_by_position(runs, treatment, control, metric).withColumnRenamed("experiment_id", "grp"))
    test = inference.paired(pairs).withColumn("family", F.lit(1)).withColumn("p", F.coalesce(F.when(~F.isnan("p"), inference.one_sided(F.col("mean_diff"), F.col("p"))), F.lit(1.0)))
    test = inference.holm(test)
    ci = inference.bca_ci(pairs.select("grp", "pair_id", (F.col("a") - F.col("b")).alias("x")), resamples=resamples).select("grp", "low")
    cover = of_task(successful(runs), treatment).groupBy(F.col("experiment_id").alias("grp")).agg(F.count_distinct("task_seed").alias("seeds"), F.count_distinct("reservoir_seed").alias("draws"))
    out = test.join(ci, "grp").join(cover, "grp")
    strong = (F.col("mean_diff") >= delta) & (F.col("low") > 0) & (F.col("adjusted") < 0.05) & (F.col("seeds") >= seeds) & (F.col("draws") >= realisations)
    return out.select(F.col("grp").alias("experiment_id"), F.when(strong, "separated").when(F.col("mean_diff") > 0, "inconclusive").otherwise("negative").alias("verdict"))


