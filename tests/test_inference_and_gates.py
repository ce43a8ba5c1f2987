"""Inference and gates: published facts, exact counts and synthetic run logs."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.functions.distributions import normal_cdf, normal_ppf, student_t_p
from gatherline.operators import gates, inference, quality, runs


def pairs_of(spark, **groups):
    rows = [(g, i, float(a), float(b)) for g, (xs, ys) in groups.items() for i, (a, b) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "grp string, pair_id long, a double, b double")


def test_student_t(spark):
    # two-sided tails from published tables
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (2.626, 100, 0.01), (1.96, 100000, 0.05), (0.0, 7, 1.0)]
    out = spark.createDataFrame(known, "t double, df long, p double").select("p", student_t_p(F.col("t"), F.col("df")).alias("got")).collect()
    assert all(r.got == pytest.approx(r.p, abs=2e-4) for r in out)
    z = spark.createDataFrame([(1.959964, 0.975)], "z double, p double").select(normal_cdf("z").alias("c"), normal_ppf("p").alias("q")).first()
    assert z.c == pytest.approx(0.975, abs=1e-6) and z.q == pytest.approx(1.959964, abs=1e-5)


def test_paired(spark):
    x = [1.0, 2.0, 4.0, 7.0]
    out = {r.grp: r for r in inference.paired(pairs_of(spark, same=(x, x), up=([v + 1 for v in x], x), mixed=([2.0, 2.5, 5.0, 9.0], x), one=([1.0], [2.0]))).collect()}
    assert out["same"].mean_diff == 0 and out["same"].d == 0 and math.isnan(out["same"].p)
    assert out["up"].d == 0 and math.isinf(out["up"].t)
    d = np.array([1.0, 0.5, 1.0, 2.0])
    assert out["mixed"].t == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and out["mixed"].d == pytest.approx(d.mean() / d.std(ddof=1))
    assert out["one"].std_diff is None
    with pytest.raises(Exception, match="two pairs"):
        inference.paired(pairs_of(spark, one=([1.0], [2.0])), strict=True).collect()


def test_wilcoxon_exact(spark):
    d = [1.5, -0.5, 2.0, 3.0, -2.5, 0.0, 4.0]
    got = inference.wilcoxon(pairs_of(spark, g=(d, [0.0] * 7))).first()
    nonzero = sorted((abs(v), v) for v in d if v)
    up = sum(i + 1 for i, (_, v) in enumerate(nonzero) if v > 0)
    w = min(up, 21 - up)
    below = sum(1 for s in itertools.product((0, 1), repeat=6) if sum(i + 1 for i, b in enumerate(s) if b) <= w)
    assert (got.n, got.statistic) == (6, w) and got.p == pytest.approx(min(1, 2 * below / 64))
    tied = inference.wilcoxon(pairs_of(spark, g=([1, 1, -1, 2], [0] * 4))).first()
    assert tied.statistic == 2.0 and tied.ties == 24


def test_bootstraps(spark):
    values = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])], "grp string, pair_id long, x double")
    ci = inference.bootstrap_ci(values, resamples=500).first()
    bca = inference.bca_ci(values, resamples=400).first()
    assert ci.low < 3 < ci.high and bca.low < 3 < bca.high
    assert inference.bca_ci(values.limit(2), resamples=50).first().low is None
    big = spark.range(400).selectExpr("'g' AS grp", "id AS pair_id", "CAST(id % 7 AS double) AS x")
    assert inference.boot_means(big, resamples=200).agg(F.stddev("mean")).first()[0] == pytest.approx(2 / 20, rel=0.2)


def test_holm_power_and_effect(spark):
    frame = lambda ps: spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, id long, p double")
    got = [r.adjusted for r in inference.holm(frame([0.01, 0.05, 0.10, 0.20, 0.50])).orderBy("id").collect()]
    assert got == pytest.approx([0.05, 0.20, 0.30, 0.40, 0.50])
    assert [r.adjusted for r in inference.holm(frame([0.51, 0.51])).collect()] == [1.0, 1.0] and inference.holm(frame([0.05])).first().adjusted == 0.05
    with pytest.raises(Exception, match=r"\[0, 1\]"):
        inference.holm(frame([1.5])).collect()
    n = spark.createDataFrame([(0.5,), (0.3,), (0.8,), (0.0,)], "d double").select("d", inference.sample_size(F.col("d")).alias("n")).collect()
    n = {r.d: r.n for r in n}
    assert n[0.5] == 32 and n[0.3] > n[0.5] > n[0.8] > 0 and n[0.0] is None
    with pytest.raises(ValueError):
        inference.sample_size(F.lit(1.0), alpha=2)
    rule = spark.createDataFrame([(0.6, 0.1, 1.0), (0.6, -0.1, 1.0), (0.1, 0.05, 1.0)], "e double, l double, h double").select(inference.effect_rule(F.col("e"), F.col("l"), F.col("h"), 0.5).alias("v"))
    assert [r.v for r in rule.collect()] == ["met", "inconclusive", "not_met"]


LOG = "run_id string, experiment_id long, timestamp_utc timestamp, task_name string, primary_metric_name string, primary_metric_value string, success string, backend_device string, circuit_hash string, task_seed long, reservoir_seed long, config_hash string"


def log_of(spark, *cells, success="True"):
    rows = []
    for experiment, task, metric, values, *backend in cells:
        for v in values:
            i = len(rows)
            rows.append((f"r{i:03d}", experiment, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), task, metric, str(v), success, (backend or ["b"])[0], f"h{(backend or ['b'])[0]}", 42 + i, 137 + i, "c"))
    return spark.createDataFrame(rows, LOG)


def verdicts(frame):
    return {r.experiment_id: r.verdict for r in frame.collect()}


def test_moment_gates(spark):
    none, haar = "ablation:no_entangle", "ablation:haar"
    log = log_of(
        spark, (1, "stm", "mc", [1.5] * 5), (1, none, "mc", [0.8] * 3), (2, "stm", "mc", [0.5] * 5), (2, none, "mc", [0.3] * 3), (3, "stm", "mc", [1.2] * 5), (3, none, "mc", [1.1] * 3), (4, "stm", "mc", [1.5] * 3), (4, none, "mc", [0.8]), (5, "stm", "mc", [1.5, "nan", "abc", 1.5, 1.5, 1.5]), (5, none, "mc", [0.8]),
    )
    m = gates.moments(log)
    assert verdicts(m.select("experiment_id", gates.g1().alias("verdict"))) == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "INSUFFICIENT_EVIDENCE", 5: "INSUFFICIENT_EVIDENCE"}
    assert m.where("experiment_id = 1").select(gates.margin()).first()[0] == pytest.approx(0.875)
    log = log_of(spark, (1, "parity", "accuracy", [0.85] * 5), (1, "ablation:random_features", "accuracy", [0.5]), (2, "parity", "accuracy", [0.6] * 5), (2, "ablation:random_features", "accuracy", [0.5]))
    assert verdicts(gates.moments(log).select("experiment_id", gates.g2().alias("verdict"))) == {1: "PASS", 2: "FAIL"}
    spread = lambda m, s: [m - s, m, m + s, m, m - s]
    log = log_of(spark, (1, "stm", "mc", spread(1.5, 0.1)), (1, haar, "mc", spread(0.5, 0.1)), (2, "stm", "mc", spread(1.5, 0.05)), (2, haar, "mc", spread(1.49, 0.05)), (3, "stm", "mc", [1.0] * 3), (3, haar, "mc", [0.5] * 3))
    assert verdicts(gates.moments(log).select("experiment_id", gates.g25().alias("verdict"))) == {1: "PASS", 2: "FAIL", 3: "INSUFFICIENT_EVIDENCE"}
    assert [r.f for r in gates.moments(log).orderBy("experiment_id").select(gates.g8().alias("f")).collect()] == [False, True, False]
    log = log_of(spark, (1, "narma", "nrmse", [0.3] * 5), (1, "esn_narma", "nrmse", [0.4] * 5), (2, "narma", "nrmse", [0.7] * 5), (2, "esn_narma", "nrmse", [0.8] * 5), (3, "narma", "nrmse", [0.3] * 3), (3, "esn_narma", "nrmse", [0.4] * 5))
    assert verdicts(gates.moments(log).select("experiment_id", gates.g4().alias("verdict"))) == {1: "PASS", 2: "PASS", 3: "INSUFFICIENT_EVIDENCE"}
    assert verdicts(gates.moments(log).select("experiment_id", gates.g4("spec").alias("verdict"))) == {1: "PASS", 2: "FAIL", 3: "INSUFFICIENT_EVIDENCE"}
    assert verdicts(gates.moments(log.withColumn("success", F.lit("False"))).select("experiment_id", gates.g4().alias("verdict"))) == dict.fromkeys((1, 2, 3), "INSUFFICIENT_EVIDENCE")


def test_g3_and_g5(spark):
    up, down = [1.5, 1.6, 1.4, 1.7, 1.5, 1.65], [1.0, 1.2, 0.8, 1.1, 1.05, 1.0]
    log = log_of(spark, (1, "stm", "mc", up), (1, "esn", "mc", down), (2, "stm", "mc", down), (2, "esn", "mc", up), (3, "stm", "mc", up[:3]), (3, "esn", "mc", down[:3]), (4, "stm", "mc", up), (5, "stm", "mc", [1.5] * 5), (5, "esn", "mc", [1.0] * 5))
    out = gates.gate_g3(log)
    assert verdicts(out) == {1: "PASS", 2: "FAIL", 3: "INSUFFICIENT_EVIDENCE", 4: "INSUFFICIENT_EVIDENCE", 5: "PASS"}
    same = log_of(spark, (1, "stm", "mc", up), (1, "esn", "mc", up))
    assert gates.gate_g3(same).first().reason == "constant differences"
    log = log_of(spark, (1, "stm", "mc", [1.0, 1.0], "a"), (1, "stm", "mc", [1.02], "b"), (2, "stm", "mc", [1.0], "a"), (2, "stm", "mc", [1.2], "b"), (3, "stm", "mc", [1.0], "a"), (4, "esn", "mc", [1.0], "a"))
    assert verdicts(gates.gate_g5(log)) == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "INSUFFICIENT_EVIDENCE"}
    split = log.where("experiment_id = 3").withColumn("circuit_hash", F.lit("other"))
    assert verdicts(gates.gate_g5(log.unionByName(split)))[3] == "FAIL"
    assert gates.all_gates(log).count() == 4 * 6


def test_calibration_faults(spark):
    as_of = F.to_timestamp(F.lit("2026-01-31T00:00:00Z"))
    good = '{"backend": "x", "timestamp_utc": "%s", "t1": %s, "t2": 60000, "readout_error": %s}'
    files = [("a", good % ("2026-01-30T00:00:00+00:00", 45000, 0.02)), ("b", "{"), ("c", '{"backend": "x"}'), ("d", good % ("soon", 1, 0)), ("e", good % ("2025-12-01T00:00:00", 1, 0)), ("f", good % ("2026-01-30", '"n"', 0)), ("g", good % ("2026-01-30", 0, 0)), ("h", good % ("2026-01-30", 1, 1.2)), ("i", "[1]")]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r.fault for r in gates.calibration_faults(frame, as_of).collect()}
    assert got == {"a": None, "b": "not a JSON object", "c": "missing readout_error, t1, t2, timestamp_utc", "d": "bad timestamp", "e": "too old", "f": "not a number", "g": "times must be positive", "h": "readout error outside [0, 1]", "i": "not a JSON object"}
    assert [gates.gate_g7(frame.where(c), as_of).first().verdict for c in ("path = 'a'", "true", "false")] == ["PASS", "FAIL", "INSUFFICIENT_EVIDENCE"]
    report = lambda rows: gates.gate_g0(spark.createDataFrame(rows, "overall string")).first().verdict
    assert [report([("PASS",)]), report([("FAIL",)]), report([(None,)]), report([])] == ["PASS", "FAIL", "FAIL", "INSUFFICIENT_EVIDENCE"]


def test_feature_tables_agree(spark):
    a = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 2.0)], "series_id long, t long, j int, x double")
    assert gates.gate_g05(a, a.withColumn("x", F.col("x") + 1e-6)).first().verdict == "PASS"
    assert gates.gate_g05(a, a.withColumn("x", F.col("x") + 1e-4)).first().verdict == "FAIL"
    assert gates.gate_g05(a, a.where("t = 0")).first().verdict == "FAIL"
    assert gates.gate_g05(a.limit(0), a.limit(0)).first().verdict == "INSUFFICIENT_EVIDENCE"


def test_log_operators(spark):
    log = log_of(spark, (1, "stm", "mc", [1.0, "inf", "nan", "x"]), (1, "esn", "mc", [2.0, 2.5]))
    assert runs.metric_values(log, "mc").count() == 4 and runs.of_task(log.drop("task_name"), "stm").count() == 0
    assert [(r.run_id, r.reason, r.next_seed) for r in runs.replacements(log).orderBy("run_id").collect()] == [("r001", "non-finite", 46), ("r002", "non-finite", 47), ("r003", "non-finite", 48)]
    assert gates.run_ids(log, "esn", "stm").first().run_ids == ["r004", "r005", "r000", "r001", "r002", "r003"]
    assert runs.pair_by_position(log, "stm", "esn", "mc").count() == 2
    near = runs.matched_baseline(log_of(spark, (1, "stm", "mc", [1.0]), (1, "esn", "mc", [1.05])), "stm", "esn", "mc").first()
    assert near.mean_value == 1.05
    ok, schema = runs.captured(lambda key, pdf: pdf.assign(v=1 / (int(key[0]) - 1)), "k long, v double")
    got = {r.k: r for r in spark.range(3).selectExpr("id AS k").groupBy("k").applyInPandas(lambda key, pdf: ok(key, pdf), schema).collect()}
    assert got[2].v == 1.0 and got[1].success is False and "ZeroDivision" in got[1].failure_reason
    bad = quality.range_violations(spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double"), [("positive", F.col("x") > 0)])
    assert bad.count() == 2
    assert spark.sql("SELECT map('a', 'PASS', 'b', 'FAIL') AS m").select(quality.all_pass("m")).first()[0] == "FAIL"


def test_gates_by_name(spark):
    log = spark.createDataFrame([(1, f"r{i}", "stm", "mc", 2.0 + i / 10, True, "cpu", "h", i, i) for i in range(5)] + [(1, "c", "ablation:no_entangle", "mc", 0.1, True, "cpu", "h", 0, 0)], "experiment_id int, run_id string, task_name string, primary_metric_name string, primary_metric_value double, success boolean, backend_device string, circuit_hash string, task_seed long, reservoir_seed long").withColumn("timestamp_utc", F.timestamp_seconds(F.col("task_seed")))
    assert gates.evaluate("G1", log).first().verdict == "PASS" and gates.evaluate("G1", log, capacity=9.0).first().verdict == "FAIL"
    assert gates.evaluate("G5", log).first().verdict == "PASS" and gates.evaluate("G3", log).first().verdict == "INSUFFICIENT_EVIDENCE"
    assert not gates.evaluate("G8", log).first().self_falsified
    assert gates.evaluate("G0", latest_report=spark.createDataFrame([("PASS",)], "overall string")).first().verdict == "PASS"
    assert gates.evaluate("G7", files=spark.createDataFrame([("p", "{")], "path string, text string"), as_of=F.timestamp_seconds(F.lit(0))).first().verdict == "FAIL"
    with pytest.raises(ValueError):
        gates.evaluate("G11", log)


def test_bootstrap_refuses_what_is_not_finite(spark):
    values = spark.createDataFrame([(1, i, float("nan") if i == 3 else 1.0) for i in range(5)], "grp int, pair_id int, x double")
    for interval in (inference.bootstrap_ci, inference.bca_ci):
        with pytest.raises(Exception, match="non-finite"):
            interval(values, resamples=10).collect()
