"""Registered queries of run logs, gates, charts, checks and streams, each with its SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.operators import charts, features, gates, inference, quality, runs
from gatherline.plans import workloads as w
from gatherline.plans.series_queries import BCA_SQL, BOOT_SQL, CORR, NARMA_SQL, T_P, r6
from gatherline.sources.scratch import scratch
from gatherline.sources import runlog
from gatherline.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RUNS, RUNS2 = w.runs_sql(), w.runs_sql(True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def seconds():
    return runs.stage_total("stages")


def both(spark: SparkSession, d: str) -> DataFrame:
    """Both mappings of the runs view in one log."""
    return w.runs(spark, d).unionByName(w.runs(spark, d, True))


BOTH = RUNS + ", " + RUNS2.replace("base AS", "base2 AS").replace("FROM base ", "FROM base2 ").replace("runs AS", "runs2 AS") + ", both_runs AS (SELECT * FROM runs UNION ALL SELECT * FROM runs2)"


# sources and sinks


@query(f"WITH {RUNS} SELECT run_id, task_name, primary_metric_name, primary_metric_value, success FROM runs")
def runs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Appended to the Parquet log, read back, appended to the CSV log, and read back again."""
    at = scratch(spark)
    log = w.runs(spark, d).drop("stages").withColumns({"primary_metric_value": F.col("primary_metric_value").cast("string"), "success": F.col("success").cast("string"), "timestamp_utc": F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ssXXX")})
    runlog.append_log(log, f"{at}/log")
    runlog.append_csv_log(spark.read.parquet(f"{at}/log"), f"{at}/csv")
    back = runlog.parsed(runlog.read_csv_log(spark, f"{at}/csv"))
    return back.select("run_id", "task_name", "primary_metric_name", F.col("primary_metric_value").cast("double").alias("primary_metric_value"), "success")


@query(f"WITH {RUNS} SELECT run_id, round(fit + score, 7) AS runtime_seconds FROM runs WHERE backend_device <> 'F'")
def keyed_insert(spark: SparkSession, d: str) -> DataFrame:
    """All runs twice into a log that has those of backend F."""
    log = w.runs(spark, d).withColumnRenamed("stages", "runtime_per_stage_seconds")
    return runlog.keyed_insert(log.unionByName(log), log.where("backend_device = 'F'")).select("run_id", F.round("runtime_seconds", 7).alias("runtime_seconds"))


@query(f"WITH {RUNS} SELECT run_id, task_name, success FROM runs")
def ordered_export(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    runlog.export_csv(w.runs(spark, d).drop("stages").withColumn("timestamp_utc", F.col("timestamp_utc").cast("string")), at)
    return spark.read.option("header", True).option("escape", '"').csv(at).select("run_id", "task_name", F.col("success").cast("boolean").alias("success"))


@query("SELECT event_type AS name, count(*) AS iterations, round(sum(value), 4) AS total_seconds, round(avg(value), 6) AS mean_seconds, round(min(value), 6) AS min_seconds, round(max(value), 6) AS max_seconds FROM events GROUP BY event_type")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    out = runs.timing_summary(w.table(spark, d, "events"), "event_type", "value")
    return out.select(F.col("event_type").alias("name"), "iterations", F.round("total_seconds", 4).alias("total_seconds"), *[r6(c, c) for c in ("mean_seconds", "min_seconds", "max_seconds")])


@query(f"WITH {RUNS} SELECT run_id, primary_metric_value AS v FROM runs WHERE task_name = 'stm' AND primary_metric_value > 2.5")
def adhoc_query(spark: SparkSession, d: str) -> DataFrame:
    return runlog.query(w.runs(spark, d), "SELECT run_id, primary_metric_value AS v FROM {runs} WHERE task_name = ? AND primary_metric_value > ?", ["stm", 2.5])


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = w.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return cells.select("event_id", F.from_json(F.to_json("m"), "map<string,bigint>")["k"].alias("k"))


@query("SELECT user_id % 10 AS grp, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    last = w.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("grp")).agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("r"))
    return last.select("grp", "r.event_id", "r.event_type")


# filters and summaries


@query(f"WITH {RUNS} SELECT run_id FROM runs WHERE success")
def success_filter(spark: SparkSession, d: str) -> DataFrame:
    return runs.successful(w.runs(spark, d).withColumn("success", F.when(F.col("success"), F.lit("True")).otherwise("False"))).select("run_id")


@query(f"WITH {RUNS} SELECT run_id, primary_metric_value AS value FROM runs WHERE primary_metric_name = 'mc'")
def metric_extract(spark: SparkSession, d: str) -> DataFrame:
    return runs.metric_values(w.runs(spark, d), "mc").select("run_id", "value")


@query(f"""WITH {RUNS}, f AS (SELECT sha256('{{"backend_device":"' || backend_device || '","task_name":"' || task_name || '"}}') AS print FROM runs) SELECT print, count(*) AS n FROM f GROUP BY print""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return w.runs(spark, d).groupBy(runs.fingerprint("task_name", "backend_device").alias("print")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def gates_like(spark: SparkSession, d: str) -> DataFrame:
    rows = w.table(spark, d, "events").withColumn("gates_passed", F.to_json(F.array("event_type", F.concat(F.lit("not-"), "event_type"))))
    return rows.where(runs.passed_gate("gates_passed", "view") | runs.passed_gate_like("gates_passed", "click")).select("event_id")


@query(f"WITH {RUNS} SELECT run_id, experiment_id FROM runs WHERE task_name = 'stm'")
def runs_by_task(spark: SparkSession, d: str) -> DataFrame:
    return runs.newest_first(w.runs(spark, d), "stm").select("run_id", "experiment_id")


@query(f"WITH {RUNS} SELECT run_id, experiment_id FROM runs WHERE task_name = 'stm' AND success")
def successful_runs_by_task(spark: SparkSession, d: str) -> DataFrame:
    return runs.newest_first(w.runs(spark, d), "stm", True).select("run_id", "experiment_id")


@query(f"WITH {RUNS} SELECT experiment_id, task_name, primary_metric_name, count(*) AS n, round(avg(primary_metric_value), 6) AS mean_value FROM runs WHERE success GROUP BY ALL")
def task_means(spark: SparkSession, d: str) -> DataFrame:
    return runs.task_means(w.runs(spark, d)).withColumn("mean_value", F.round("mean_value", 6))


@query(f"""WITH {RUNS} SELECT experiment_id, round(sqrt(coalesce(var_samp(primary_metric_value) FILTER (task_name = 'stm'), 0) / count(*) FILTER (task_name = 'stm')
  + coalesce(var_samp(primary_metric_value) FILTER (task_name = 'ablation:haar'), 0) / count(*) FILTER (task_name = 'ablation:haar')), 6) AS se FROM runs WHERE success GROUP BY experiment_id""")
def pooled_se(spark: SparkSession, d: str) -> DataFrame:
    return gates.moments(w.runs(spark, d)).select("experiment_id", r6(gates.pooled_se("stm", "haar"), "se"))


@query(f"WITH {RUNS} SELECT experiment_id, count(*) AS total_runs, round(sum(fit + score), 7) AS total_seconds, round(sum(fit + score) * 15 / 3.6e6::DOUBLE, 6) AS kwh FROM runs GROUP BY experiment_id")
def cumulative_compute(spark: SparkSession, d: str) -> DataFrame:
    return runs.compute_totals(w.runs(spark, d), seconds()).select("experiment_id", "total_runs", F.round("total_seconds", 7).alias("total_seconds"), r6("kwh", "kwh"))


@query(f"WITH {RUNS} SELECT run_id, count(*) OVER o AS runs_so_far, round(sum(fit + score) OVER o, 7) AS seconds_so_far FROM runs WINDOW o AS (PARTITION BY experiment_id ORDER BY timestamp_utc, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_compute(spark: SparkSession, d: str) -> DataFrame:
    return runs.running_totals(w.runs(spark, d), seconds()).select("run_id", "runs_so_far", F.round("seconds_so_far", 7).alias("seconds_so_far"))


@query(f"WITH {RUNS} SELECT experiment_id, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM runs GROUP BY experiment_id")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_summary(w.runs(spark, d))


@query(f"WITH {RUNS} SELECT experiment_id, string_agg(DISTINCT backend_device, ',' ORDER BY backend_device) AS backends, count(DISTINCT circuit_hash) AS hashes FROM runs WHERE success GROUP BY experiment_id")
def distinct_backends(spark: SparkSession, d: str) -> DataFrame:
    return runs.distinct_backends(w.runs(spark, d)).withColumn("backends", F.array_join("backends", ","))


@query(f"WITH {RUNS}, m AS (SELECT experiment_id, backend_device, avg(primary_metric_value) AS v FROM runs WHERE success AND task_name = 'stm' GROUP BY 1, 2) SELECT experiment_id, count(*) AS backends, round(max(v) - min(v), 6) AS spread FROM m GROUP BY 1")
def backend_spread(spark: SparkSession, d: str) -> DataFrame:
    return runs.backend_spread(w.runs(spark, d)).withColumn("spread", F.round("spread", 6))


@query(f"WITH {RUNS} SELECT run_id, round(fit + score, 7) AS total FROM runs")
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return w.runs(spark, d).select("run_id", F.round(seconds(), 7).alias("total"))


@query(f"WITH {RUNS} SELECT experiment_id, CASE task_name WHEN 'stm' THEN 'treatment' ELSE 'control' END AS role, run_id FROM runs WHERE success AND task_name IN ('stm', 'ablation:no_entangle')")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return runs.evidence_ids(w.runs(spark, d), "stm", "ablation:no_entangle")


@query(f"WITH {RUNS}, c AS (SELECT config_path, min(task_seed) AS t0, min(reservoir_seed) AS r0 FROM runs GROUP BY 1) SELECT config_path, i::INT AS seed_index, t0 + i AS task_seed, r0 + i AS reservoir_seed FROM c, range(3) r(i)")
def seed_grid(spark: SparkSession, d: str) -> DataFrame:
    configs = w.runs(spark, d).groupBy("config_path").agg(F.min("task_seed").alias("task_seed"), F.min("reservoir_seed").alias("reservoir_seed"))
    return runs.seed_runs(configs, 3)


@query(f"WITH {RUNS} SELECT DISTINCT task_name, s AS scale, l AS leak, (row_number() OVER (PARTITION BY task_name, run_id ORDER BY s, l) - 1)::INT AS grid_pos FROM runs, (VALUES (0.5::DOUBLE), (1.0)) a(s), (VALUES (0.1::DOUBLE), (0.3), (1.0)) b(l)")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    return w.runs(spark, d).select("task_name").distinct().crossJoin(F.broadcast(runs.grid(spark, scale=(0.5, 1.0), leak=(0.1, 0.3, 1.0))))


PAIRED = "WITH {runs}, x AS (SELECT experiment_id, row_number() OVER (PARTITION BY experiment_id, task_name ORDER BY timestamp_utc, run_id) AS rn, task_name, task_seed, reservoir_seed, primary_metric_value AS v FROM runs WHERE success)"


@query(PAIRED.format(runs=RUNS) + " SELECT q.experiment_id, q.rn AS pair_id, q.v AS a, e.v AS b FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.rn = e.rn WHERE q.task_name = 'stm' AND e.task_name = 'esn'")
def pair_by_position(spark: SparkSession, d: str) -> DataFrame:
    return runs.pair_by_position(w.runs(spark, d), "stm", "esn", "mc").select("experiment_id", "pair_id", "a", "b")


@query(PAIRED.format(runs=RUNS) + " SELECT q.experiment_id, q.task_seed, q.v AS a, e.v AS b FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.task_seed = e.task_seed AND q.reservoir_seed = e.reservoir_seed WHERE q.task_name = 'stm' AND e.task_name = 'esn'")
def pair_by_key(spark: SparkSession, d: str) -> DataFrame:
    return runs.pair_by_key(w.runs(spark, d), "stm", "esn", "mc").select("experiment_id", "task_seed", "a", "b")


# gates

_SIDE = "{f}(primary_metric_value) FILTER (success AND task_name = '{t}' AND primary_metric_name = '{m}')"
MOMENTS = "m AS (SELECT experiment_id, " + ", ".join(f"{_SIDE.format(f=f, t=t, m=m)} AS {name}_{s}" for s, (t, m) in gates.SIDES.items() for f, name in (("count", "n"), ("avg", "mean"), ("var_samp", "var"))) + " FROM {table} GROUP BY experiment_id)"
_VERDICT = "CASE WHEN NOT coalesce({enough}, false) THEN 'INSUFFICIENT_EVIDENCE' WHEN {passes} THEN 'PASS' ELSE 'FAIL' END"
G1 = _VERDICT.format(enough="n_stm >= 5 AND n_plain >= 1", passes="mean_stm > 1.0 AND CASE WHEN mean_plain > 0 THEN (mean_stm - mean_plain) / mean_plain ELSE 0 END >= 0.20")
G2 = _VERDICT.format(enough="n_parity >= 5 AND n_random >= 1", passes="mean_parity > 0.70 AND mean_random < 0.60")
_SE = "sqrt(coalesce(var_stm, 0) / n_stm + coalesce(var_{0}, 0) / n_{0})"
G25 = _VERDICT.format(enough=f"n_stm >= 3 AND n_haar >= 3 AND {_SE.format('haar')} > 0", passes=f"mean_stm - mean_haar >= {_SE.format('haar')}")
G4 = _VERDICT.format(enough="n_narma >= 5 AND n_esn_narma >= 5", passes="mean_narma < mean_esn_narma")


def _moments(spark: SparkSession, d: str, second: bool | None = False) -> DataFrame:
    return gates.moments(both(spark, d) if second is None else w.runs(spark, d, second))


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')} SELECT experiment_id, {G1} AS verdict, n_stm, n_plain, round(mean_stm, 6) AS mean_stm, round(mean_plain, 6) AS mean_plain FROM m")
def gate_g1(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("experiment_id", gates.g1().alias("verdict"), "n_stm", "n_plain", r6("mean_stm", "mean_stm"), r6("mean_plain", "mean_plain"))


@query(f"WITH {BOTH}, {MOMENTS.format(table='both_runs')} SELECT experiment_id, {G2} AS verdict, n_parity, n_random FROM m")
def gate_g2(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d, None).select("experiment_id", gates.g2().alias("verdict"), "n_parity", "n_random")


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')} SELECT experiment_id, {G25} AS verdict, round({_SE.format('haar')}, 6) AS se FROM m")
def gate_g25(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("experiment_id", gates.g25().alias("verdict"), r6(gates.pooled_se("stm", "haar"), "se"))


@query(f"WITH {RUNS2}, {MOMENTS.format(table='runs')} SELECT experiment_id, {G4} AS verdict, " + _VERDICT.format(enough="n_narma >= 5 AND n_esn_narma >= 5", passes="mean_narma < 0.60 AND mean_narma <= 2 * mean_esn_narma") + " AS spec_verdict FROM m")
def gate_g4(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d, True).select("experiment_id", gates.g4().alias("verdict"), gates.g4("spec").alias("spec_verdict"))


G3_SQL = PAIRED.format(runs=RUNS) + f""", pr AS (SELECT q.experiment_id, q.v - e.v AS d FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.rn = e.rn WHERE q.task_name = 'stm' AND e.task_name = 'esn'),
ts AS (SELECT experiment_id, count(*) AS pairs, avg(d) AS md, count(*) - 1 AS df, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM pr GROUP BY 1 HAVING count(*) > 2),
tp AS (SELECT *, {T_P} AS p2 FROM ts), {MOMENTS.format(table='runs')},
g3 AS (SELECT m.experiment_id, pairs, CASE WHEN md > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p, {{verdict}} AS verdict FROM m LEFT JOIN tp ON tp.experiment_id = m.experiment_id)""".replace("{verdict}", _VERDICT.format(enough="n_stm >= 5 AND n_esn >= 5 AND p2 IS NOT NULL", passes="mean_stm > mean_esn AND CASE WHEN md > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END < 0.05"))


@query(G3_SQL + " SELECT experiment_id, verdict, pairs, round(p, 6) AS adjusted_p FROM g3")
def gate_g3(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_g3(w.runs(spark, d)).select("experiment_id", "verdict", "pairs", r6("adjusted_p", "adjusted_p"))


G5_SQL = f"""bm AS (SELECT experiment_id, backend_device, avg(primary_metric_value) AS v FROM runs WHERE success AND task_name = 'stm' GROUP BY 1, 2),
bs AS (SELECT experiment_id, count(*) AS backends, max(v) - min(v) AS spread, min(backend_device) AS only_one FROM bm GROUP BY 1),
bh AS (SELECT bs.experiment_id, count(DISTINCT circuit_hash) AS hashes FROM bs JOIN runs ON runs.experiment_id = bs.experiment_id AND backend_device = only_one WHERE success GROUP BY 1),
g5 AS (SELECT e.experiment_id, {_VERDICT.format(enough="backends >= 1", passes="CASE WHEN backends >= 2 THEN spread <= 0.05 ELSE hashes = 1 END")} AS verdict
  FROM (SELECT DISTINCT experiment_id FROM runs) e LEFT JOIN bs ON bs.experiment_id = e.experiment_id LEFT JOIN bh ON bh.experiment_id = e.experiment_id)"""


@query(f"WITH {RUNS}, {G5_SQL} SELECT experiment_id, verdict FROM g5")
def gate_g5(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_g5(w.runs(spark, d)).select("experiment_id", "verdict")


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')} SELECT experiment_id, " + " OR ".join(f"coalesce(n_stm > 0 AND n_{c} > 0 AND abs(mean_stm - mean_{c}) <= {_SE.format(c)}, false)" for c in ("plain", "haar")) + " AS self_falsified FROM m")
def gate_g8(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("experiment_id", gates.g8().alias("self_falsified"))


GATE_ROWS = " UNION ALL ".join(f"SELECT experiment_id, '{n}' AS gate, {v} AS verdict FROM m" for n, v in (("G1", G1), ("G2", G2), ("G2.5", G25), ("G4", G4)))


@query(f"{G3_SQL}, {G5_SQL} {GATE_ROWS} UNION ALL SELECT experiment_id, 'G3', verdict FROM g3 UNION ALL SELECT experiment_id, 'G5', verdict FROM g5")
def gate_all(spark: SparkSession, d: str) -> DataFrame:
    return gates.all_gates(w.runs(spark, d))


DRIFT = "drift AS (SELECT config_path FROM runs GROUP BY 1 HAVING count(DISTINCT config_hash) > 1)"
UNLIKE = "unlike AS (SELECT circuit_hash FROM runs GROUP BY circuit_hash, task_seed, task_name HAVING max(primary_metric_value) - min(primary_metric_value) > 1e-9)"


@query(f"WITH {RUNS}, {DRIFT}, {UNLIKE} SELECT 'G0' AS gate, CASE WHEN (SELECT count(*) FROM drift) + (SELECT count(*) FROM unlike) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict")
def gate_g0(spark: SparkSession, d: str) -> DataFrame:
    """A health report from the checks on the runs view, written, read back and judged."""
    at = scratch(spark)
    log = w.runs(spark, d)
    checks = quality.rolled_up({"config_drift": quality.config_drift(log), "fingerprints": quality.fingerprint_consistency(log)})
    overall = checks.where("check_name = 'overall'").select(F.to_json(F.struct(F.col("status").alias("overall"), F.lit("2026-01-01T00:00:00Z").alias("timestamp_utc"))).alias("value"))
    overall.coalesce(1).write.text(f"{at}/text")
    spark.read.text(f"{at}/text").select(F.from_json("value", "overall string, timestamp_utc string").alias("h")).select("h.*").coalesce(1).write.json(f"{at}/reports")
    return gates.gate_g0(runlog.latest_report(spark, f"{at}/reports"))


@query(f"""WITH {w.SERIES_SQL}, moved AS (SELECT u AS x, u + CASE WHEN t % 2 = 0 THEN 2e-6 ELSE 0 END AS near, u + CASE WHEN t = 3 THEN 2e-5 ELSE 0 END AS far FROM series),
gaps AS (SELECT max(abs(x - near)) AS near, max(abs(x - far)) AS far FROM moved)
SELECT 'G0.5' AS gate, 'near' AS variant, CASE WHEN near IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN near <= 1e-5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM gaps
UNION ALL SELECT 'G0.5', 'far', CASE WHEN far IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN far <= 1e-5 THEN 'PASS' ELSE 'FAIL' END FROM gaps""")
def gate_g05(spark: SparkSession, d: str) -> DataFrame:
    """Series against two copies: one off by less than the tolerance in every second entry, one by more in some."""
    left = w.series(spark, d).select("series_id", "t", F.lit(0).alias("j"), F.col("u").alias("x"))
    near = left.withColumn("x", F.when(F.col("t") % 2 == 0, F.col("x") + 2e-6).otherwise(F.col("x")))
    far = left.withColumn("x", F.when(F.col("t") == 3, F.col("x") + 2e-5).otherwise(F.col("x")))
    judged = [gates.gate_g05(left, right).select("gate", F.lit(name).alias("variant"), "verdict") for name, right in (("near", near), ("far", far))]
    return judged[0].unionByName(judged[1])


@query("""SELECT CASE event_id % 10 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'times must be positive' WHEN 3 THEN 'missing t2' WHEN 4 THEN 'readout error outside [0, 1]'
  WHEN 8 THEN 'too old' WHEN 9 THEN 'too old' END AS fault, count(*) AS n FROM events GROUP BY 1""")
def gate_g7(spark: SparkSession, d: str) -> DataFrame:
    """A calibration text for each event: its age from the event's number, faulty where that ends in certain digits."""
    k = F.col("event_id") % 10
    at = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) - k * 4 * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(k == 1, "{").otherwise(F.to_json(F.struct(F.lit("aer").alias("backend"), at.alias("timestamp_utc"), F.when(k == 2, -1.0).otherwise(45000.0).alias("t1"), F.when(k != 3, 60000.0).alias("t2"), F.when(k == 4, 1.2).otherwise(0.02).alias("readout_error"))))
    files = w.table(spark, d, "events").select(F.col("event_id").alias("path"), text.alias("text"))
    return gates.calibration_faults(files, F.timestamp_seconds(F.lit(1_767_225_600))).groupBy("fault").agg(F.count("*").alias("n"))


@query(PAIRED.format(runs=RUNS) + f""", pairs AS (SELECT q.experiment_id AS grp, q.rn AS pair_id, q.v AS a, e.v AS b FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.rn = e.rn WHERE q.task_name = 'stm' AND e.task_name = 'ablation:haar'), {BOOT_SQL}, {BCA_SQL},
ts AS (SELECT grp, avg(a - b) AS md, stddev_samp(a - b) AS sd, count(*) - 1 AS df, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM pairs GROUP BY grp),
tp AS (SELECT *, coalesce(CASE WHEN df >= 1 THEN CASE WHEN md > 0 THEN {T_P} / 2 ELSE 1 - {T_P} / 2 END END, 1.0) AS p FROM ts),
hs AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS scaled FROM tp),
hp AS (SELECT *, least(1.0, max(scaled) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM hs),
cv AS (SELECT experiment_id AS grp, count(DISTINCT task_seed) AS seeds, count(DISTINCT reservoir_seed) AS draws FROM runs WHERE success AND task_name = 'stm' GROUP BY 1)
SELECT hp.grp AS experiment_id, CASE WHEN md >= 0.05 AND coalesce(low > 0, false) AND adjusted < 0.05 AND seeds >= 5 AND draws >= 3 THEN 'separated' WHEN md > 0 THEN 'inconclusive' ELSE 'negative' END AS verdict
FROM hp JOIN bca ON bca.grp = hp.grp JOIN cv ON cv.grp = hp.grp""")
def separation_verdict(spark: SparkSession, d: str) -> DataFrame:
    return gates.separation(w.runs(spark, d), "stm", "ablation:haar", "mc", 0.05)


@query(f"""WITH {w.PAIRS_SQL}, {BOOT_SQL}, q AS (SELECT grp, effect, quantile_cont(m, 0.025) AS low FROM boot GROUP BY grp, effect)
SELECT grp, CASE WHEN effect >= 1000 AND low > 0 THEN 'met' WHEN effect >= 1000 THEN 'inconclusive' ELSE 'not_met' END AS verdict FROM q""")
def effect_rule(spark: SparkSession, d: str) -> DataFrame:
    values = w.pairs(spark, d).select("grp", "pair_id", (F.col("a") - F.col("b")).alias("x"))
    out = inference.bootstrap_ci(values).join(values.groupBy("grp").agg(F.avg("x").alias("effect")), "grp")
    return out.select("grp", inference.effect_rule(F.col("effect"), F.col("low"), F.col("high"), 1000.0).alias("verdict"))


# chart tables


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round(power({CORR.format('p', 'y')}, 2), 6) AS r2, power({CORR.format('p', 'y')}, 2) >= 0.1 AS above FROM scores GROUP BY series_id, k")
def chart_delay_r2(spark: SparkSession, d: str) -> DataFrame:
    return charts.delay_r2(w.scores(spark, d), threshold=0.1).withColumn("r2", F.round("r2", 6))


@query(f"WITH {w.SCORES_SQL}, r AS (SELECT series_id, k, power({CORR.format('p', 'y')}, 2) AS r2 FROM scores GROUP BY 1, 2) SELECT series_id, " + ", ".join(f"round(max(r2) FILTER (k = {k}), 6) AS k{k}" for k in range(4)) + " FROM r GROUP BY series_id")
def chart_delay_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return charts.delay_heatmap(w.scores(spark, d), 3).select("series_id", *[r6(f"k{k}", f"k{k}") for k in range(4)])


@query(f"WITH {RUNS} SELECT experiment_id, task_name, primary_metric_name, round(avg(primary_metric_value), 6) AS mean_value, round(stddev_samp(primary_metric_value), 6) AS sd, count(*) AS n FROM runs WHERE success GROUP BY ALL")
def chart_method_scores(spark: SparkSession, d: str) -> DataFrame:
    return charts.method_scores(w.runs(spark, d)).withColumns({"mean_value": F.round("mean_value", 6), "sd": F.round("sd", 6)})


@query(f"WITH {RUNS}, s AS (SELECT experiment_id, 'fit' AS stage, fit AS s FROM runs UNION ALL SELECT experiment_id, 'score', score FROM runs) SELECT experiment_id, stage, round(sum(s), 7) AS total_seconds, round(avg(s), 6) AS mean_seconds FROM s GROUP BY 1, 2")
def chart_stage_seconds(spark: SparkSession, d: str) -> DataFrame:
    return charts.stage_seconds(w.runs(spark, d)).withColumns({"total_seconds": F.round("total_seconds", 7), "mean_seconds": F.round("mean_seconds", 6)})


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')}, g AS (SELECT experiment_id, {G1} AS v FROM m) SELECT experiment_id, CASE v WHEN 'PASS' THEN 1 WHEN 'FAIL' THEN -1 ELSE 0 END AS score FROM g")
def chart_gate_scores(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("experiment_id", charts.verdict_score(gates.g1()).alias("score"))


@query("WITH l AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem), p AS (SELECT * FROM (VALUES ('l_quantity', 'l_discount', 1), ('l_quantity', 'l_tax', 2), ('l_discount', 'l_tax', 3)) v(a, b, i)), r AS (SELECT corr(q, d) AS r1, corr(q, t) AS r2, corr(d, t) AS r3 FROM l), c AS (SELECT a, b, CASE i WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS r FROM p, r) SELECT a, b, round(r, 6) AS r FROM c UNION ALL SELECT b, a, round(r, 6) FROM c UNION ALL SELECT n, n, 1.0 FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) s(n)")
def chart_metric_correlation(spark: SparkSession, d: str) -> DataFrame:
    return charts.metric_correlation(w.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


@query(PAIRED.format(runs=RUNS) + f""", pr AS (SELECT q.experiment_id, q.v - e.v AS d FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.rn = e.rn WHERE q.task_name = 'stm' AND e.task_name = 'esn'),
ts AS (SELECT experiment_id, avg(d) AS md, count(*) - 1 AS df, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM pr GROUP BY 1 HAVING count(*) > 2), tp AS (SELECT *, {T_P} AS p FROM ts),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS scaled FROM tp)
SELECT experiment_id, round(md, 6) AS paired_delta, round(least(1.0, max(scaled) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS holm_p FROM s""")
def chart_headline(spark: SparkSession, d: str) -> DataFrame:
    tests = inference.paired(runs.pair_by_position(w.runs(spark, d), "stm", "esn", "mc"), ("experiment_id",)).where("n > 2")
    return inference.holm(tests.withColumn("family", F.lit(1))).select("experiment_id", r6("mean_diff", "paired_delta"), r6("adjusted", "holm_p"))


# checks


@query(f"WITH {RUNS} SELECT experiment_id, 'primary_metric_value' AS name, count(*) FILTER (run_id::BIGINT % 7 IN (0, 1, 2)) AS bad FROM runs GROUP BY 1")
def finite_report(spark: SparkSession, d: str) -> DataFrame:
    """Runs of which three in seven, by number, have no metric, or one that is NaN or infinite."""
    k, v = F.col("run_id").cast("bigint") % 7, F.col("primary_metric_value")
    spoiled = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(v)
    return quality.finite_report(w.runs(spark, d).withColumn("primary_metric_value", spoiled), ["primary_metric_value"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'quantity' ELSE 'discount' END AS rule, count(*) AS n FROM lineitem WHERE l_quantity > 40 OR l_discount > 0.05 GROUP BY ALL")
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    bad = quality.range_violations(w.table(spark, d, "lineitem"), [("quantity", F.col("l_quantity") <= 40), ("discount", F.col("l_discount") <= 0.05)])
    return bad.groupBy("l_orderkey", "l_linenumber", "rule").agg(F.count("*").alias("n"))


@query(f"WITH {w.SERIES_SQL} SELECT series_id, round(max(CASE WHEN t = 3 THEN 0.5 ELSE 0 END), 6)::DOUBLE AS max_diff, count(*) FILTER (t = 3) AS beyond, count(*) FILTER (t = 5) AS unmatched FROM series GROUP BY series_id")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    left = w.series(spark, d).select("series_id", "t", F.lit(0).alias("j"), F.col("u").alias("x"))
    right = left.where("t <> 5").withColumn("x", F.when(F.col("t") == 3, F.col("x") + 0.5).otherwise(F.col("x")))
    return quality.table_diff(left, right).withColumn("max_diff", F.round("max_diff", 6))


@query(f"WITH {RUNS} SELECT config_path, count(DISTINCT config_hash) AS hashes FROM runs GROUP BY 1 HAVING count(DISTINCT config_hash) > 1")
def config_drift(spark: SparkSession, d: str) -> DataFrame:
    return quality.config_drift(w.runs(spark, d))


@query(f"WITH {RUNS} SELECT circuit_hash, task_name, count(*) AS n, max(primary_metric_value) - min(primary_metric_value) AS spread FROM runs GROUP BY 1, 2 HAVING max(primary_metric_value) - min(primary_metric_value) > 1e-9")
def fingerprint_consistency(spark: SparkSession, d: str) -> DataFrame:
    return quality.fingerprint_consistency(w.runs(spark, d), ("circuit_hash", "task_name"))


@query(f"WITH {RUNS}, c AS (SELECT experiment_id, task_name, count(DISTINCT task_seed) AS seeds, count(DISTINCT reservoir_seed) AS realisations FROM runs WHERE success GROUP BY 1, 2) SELECT *, seeds >= 5 AND realisations >= 3 AS covered FROM c")
def cell_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.cell_coverage(w.runs(spark, d))


@query(f"WITH {RUNS}, t AS (SELECT *, max(task_seed) OVER (PARTITION BY experiment_id, task_name) AS top FROM runs) SELECT experiment_id, task_name, run_id, task_seed, 'failed' AS reason, top + row_number() OVER (PARTITION BY experiment_id, task_name ORDER BY task_seed, run_id) AS next_seed FROM t WHERE NOT success")
def seed_replacements(spark: SparkSession, d: str) -> DataFrame:
    return runs.replacements(w.runs(spark, d))


@query(f"""WITH {RUNS}, g AS (SELECT experiment_id, avg(primary_metric_value) AS target FROM runs WHERE success AND task_name = 'stm' GROUP BY 1),
b AS (SELECT experiment_id, config_hash, avg(primary_metric_value) AS mean_value FROM runs WHERE success AND task_name = 'esn' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY abs(mean_value - target), config_hash) AS rn FROM b JOIN g USING (experiment_id) WHERE abs(mean_value - target) <= 0.1 * abs(target))
SELECT experiment_id, config_hash, round(mean_value, 6) AS mean_value, round(target, 6) AS target FROM r WHERE rn = 1""")
def matched_baseline(spark: SparkSession, d: str) -> DataFrame:
    return runs.matched_baseline(w.runs(spark, d), "stm", "esn", "mc").withColumns({"mean_value": F.round("mean_value", 6), "target": F.round("target", 6)})


@query(f"""WITH {RUNS}, {DRIFT}, {UNLIKE}, twice AS (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT 'determinism' AS check_name, (SELECT count(*) FROM twice) AS n UNION ALL SELECT 'config_drift', (SELECT count(*) FROM drift) UNION ALL SELECT 'fingerprints', (SELECT count(*) FROM unlike))
SELECT check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c UNION ALL SELECT 'overall', CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END FROM c""")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = w.series(spark, d)
    log = w.runs(spark, d)
    return quality.rolled_up({"determinism": quality.differences(rows, w.series(spark, d)), "config_drift": quality.config_drift(log), "fingerprints": quality.fingerprint_consistency(log)})


@query(f"""WITH {w.SERIES_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (t > 0) AS later, count(DISTINCT series_id) AS s FROM series)
SELECT 'again' AS variant, n AS rows, n AS other_rows, true AS same FROM n UNION ALL SELECT 'dealt anew', n, n, true FROM n UNION ALL SELECT 'a row less', n, later, n = later FROM n
UNION ALL SELECT 'a row twice', n, n + s, s = 0 FROM n UNION ALL SELECT 'a digit off', n, n, n = 0 FROM n""")
def determinism(spark: SparkSession, d: str) -> DataFrame:
    """The series view and its features against the same made again, and against copies that aren't the same."""
    made = lambda: features.cosine_features(w.series(spark, d), features.cosine_params(spark, 3))
    rows = made()
    others = {
        "again": made(), "dealt anew": made().repartition(7, "t"), "a row less": rows.where("t > 0"), "a row twice": rows.unionByName(rows.where("t = 0")),
        "a digit off": rows.withColumn("u", F.when(F.col("t") == 0, F.col("u") + 1e-9).otherwise(F.col("u"))),
    }
    return reduce(DataFrame.unionByName, [quality.compared_tables(rows, other).select(F.lit(name).alias("variant"), "rows", "other_rows", "same") for name, other in others.items()])


@query("SELECT event_type AS name, count(*) AS iterations, round(sum(value), 4) AS total_seconds, round(avg(value), 6) AS mean_seconds, round(min(value), 6) AS min_seconds, round(max(value), 6) AS max_seconds FROM events GROUP BY event_type")
def saved_timings(spark: SparkSession, d: str) -> DataFrame:
    """The timing summary saved as JSON and read back."""
    at, out = scratch(spark), timing_summary(spark, d)
    runlog.save_timings(out, at)
    return spark.read.schema(out.schema).json(at)


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')}, g AS ({GATE_ROWS}) SELECT experiment_id, gate, verdict, 2::BIGINT AS evaluations FROM g")
def gate_history(spark: SparkSession, d: str) -> DataFrame:
    """Gates judged on the failed runs' and then on all runs' log, both appended; the later verdict is the current one."""
    at, log = scratch(spark), w.runs(spark, d)
    for when, runs_then in (("2026-01-01", log.withColumn("primary_metric_value", F.lit(0.0))), ("2026-01-02", log)):
        runlog.append_gate_results(live.verdicts(runs_then).withColumn("evaluated_at", F.lit(when).cast("timestamp")), at)
    history = spark.read.parquet(at)
    counts = history.groupBy("experiment_id", "gate").agg(F.count("*").alias("evaluations"))
    return runlog.current_gate_results(history).join(counts, ["experiment_id", "gate"]).select("experiment_id", "gate", "verdict", "evaluations")


@query(PAIRED.format(runs=RUNS) + f""", pairs AS (SELECT experiment_id || ':' || task_name AS grp, experiment_id, task_name AS system, rn AS pair_id, v AS a, 0 AS b FROM x WHERE task_name <> 'parity'), {BOOT_SQL},
cell AS (SELECT grp, experiment_id, system, count(*) AS n, avg(a) AS mean FROM pairs GROUP BY ALL), ci AS (SELECT grp, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM boot GROUP BY grp),
pr AS (SELECT q.experiment_id, q.task_name AS system, q.v - e.v AS d FROM x q JOIN x e ON q.experiment_id = e.experiment_id AND q.rn = e.rn WHERE q.task_name NOT IN ('parity', 'esn') AND e.task_name = 'esn'),
ts AS (SELECT experiment_id, system, avg(d) AS md, count(*) - 1 AS df, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM pr GROUP BY ALL), tp AS (SELECT *, {T_P} AS p FROM ts WHERE df > 1),
sc AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS scaled FROM tp), ho AS (SELECT *, least(1.0, max(scaled) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM sc)
SELECT c.experiment_id, c.system, c.n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(ts.md, 6) AS paired_delta, round(adjusted, 6) AS holm_p
FROM cell c JOIN ci ON ci.grp = c.grp LEFT JOIN ts ON ts.experiment_id = c.experiment_id AND ts.system = c.system LEFT JOIN ho ON ho.experiment_id = c.experiment_id AND ho.system = c.system""")
def headline_table(spark: SparkSession, d: str) -> DataFrame:
    out = charts.headline(w.runs(spark, d), "mc", "esn")
    return out.select("experiment_id", "system", "n", *[r6(c, c) for c in ("mean", "low", "high", "paired_delta", "holm_p")])


@query(f"""WITH {RUNS}, c AS (SELECT experiment_id, task_name, count(*) AS n, sum(fit + score) AS s FROM runs GROUP BY ALL)
SELECT experiment_id, task_name, n, round(s, 7) AS cell_seconds, round(s / n, 6) AS mean_seconds, round(sum(s) OVER (PARTITION BY experiment_id), 7) AS group_seconds, round(sum(s) OVER (PARTITION BY experiment_id) * 15 / 3.6e6, 9) AS group_kwh FROM c""")
def compute_table(spark: SparkSession, d: str) -> DataFrame:
    out = charts.compute_table(w.runs(spark, d), seconds())
    return out.select("experiment_id", "task_name", "n", r6("mean_seconds", "mean_seconds"), *[F.round(c, 7).alias(c) for c in ("cell_seconds", "group_seconds")], F.round("group_kwh", 9).alias("group_kwh"))


# streams


def _arriving(spark: SparkSession, d: str, at: str) -> DataFrame:
    log = w.runs(spark, d).withColumn("runtime_seconds", seconds()).drop("stages")
    log.write.parquet(f"{at}/in")
    return spark.readStream.schema(log.schema).parquet(f"{at}/in")


@query(f"WITH {RUNS} SELECT experiment_id, count(*) AS total_runs, round(sum(fit + score), 7) AS total_seconds FROM runs GROUP BY experiment_id")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    out = live.run_available(live.totals(_arriving(spark, d, at), late="3650 days"), at, "totals")
    return out.select("experiment_id", "total_runs", F.round("total_seconds", 7).alias("total_seconds"))


@query(f"WITH {RUNS}, {MOMENTS.format(table='runs')} {GATE_ROWS}")
def stream_gates(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    return live.run_available(live.verdicts(_arriving(spark, d, at)), at, "verdicts")


#: Spark's setting that state of lists and timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(NARMA_SQL + """SELECT s.series_id, s.t, round(coalesce(CASE WHEN r.t >= 10 THEN r.ys[10] END, 0.0), 6) AS y,
  round(0.5 * u01 + 0.5 * avg(u01) OVER (PARTITION BY s.series_id ORDER BY s.t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS blend
FROM series s LEFT JOIN rec r ON r.series_id = s.series_id AND r.t = s.t""")
def stream_series(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream that arrives out of order by up to three days; a last arrival, far ahead, ends the wait."""
    at, start = scratch(spark), "2024-01-01"
    rows = w.table(spark, d, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.least(F.col("value"), F.lit(500.0)) / 1000).alias("u"))
    arrival = F.floor((F.datediff("ts", F.to_date(F.lit(start))) + F.col("id") % 4) / 6)
    last = rows.agg(F.max(arrival)).first()[0]
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("bigint").alias("series_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("u"))
    parts = [rows.where(arrival == k) for k in range((-1 if last is None else last) + 1)]  # some five for a month
    for part in [*parts, end.where("ts IS NOT NULL")]:
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        out = live.run_appended(live.live_series(stream, late="4 days"), at, "series")
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return out.where("series_id IS NOT NULL").select("series_id", "t", r6("y", "y"), F.round("blend", 9).alias("blend"))
