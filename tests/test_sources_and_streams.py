"""Round trips of logs and reports, streams against batch, and the registered queries."""

from __future__ import annotations

import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gatherline.operators import series
from gatherline.plans import run_queries, series_queries
from gatherline.sources import runlog
from gatherline.sources.schemas import RUN_COLUMNS
from gatherline.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log(spark):
    rows = spark.range(4).select(F.format_string("r%d", "id").alias("run_id"), F.format_string("2024-01-0%dT00:00:00+00:00", F.col("id") + 1).alias("timestamp_utc"), F.lit("stm").alias("task_name"), (F.col("id") != 3).cast("string").alias("success"))
    return rows.withColumns({"runtime_per_stage_seconds": F.when(F.col("run_id") == "r3", F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit('st"age,1'), F.lit(2.5))), "artifact_paths": F.array(F.lit("path/to/file.png")), "failure_reason": F.when(F.col("run_id") == "r3", "test error, \"quoted\"")})


def test_logs_round_trip(spark, log, tmp_path):
    at = str(tmp_path)
    runlog.append_csv_log(log, f"{at}/csv")
    raw = runlog.read_csv_log(spark, f"{at}/csv")
    assert tuple(raw.columns) == RUN_COLUMNS and len(RUN_COLUMNS) == 22
    back = {r.run_id: r for r in runlog.parsed(raw).collect()}
    assert back["r0"].runtime_per_stage_seconds == {'st"age,1': 2.5} and back["r0"].artifact_paths == ["path/to/file.png"] and back["r0"].success is True
    assert back["r3"].success is False and back["r3"].failure_reason == 'test error, "quoted"' and back["r3"].timestamp_utc.day == 4
    runlog.append_log(log, f"{at}/log")
    runlog.append_log(log.withColumn("task_name", F.lit("esn")), f"{at}/log")
    assert spark.read.parquet(f"{at}/log").where("task_name = 'esn'").count() == 4
    assert runlog.read_csv_log(spark, f"{at}/none", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runlog.read_csv_log(spark, f"{at}/none")


def test_strict_keyed_insert_and_query(spark, log):
    for old in (log.limit(0).unionByName(log), log.limit(0)):
        new = log if old.count() else log.unionByName(log)
        with pytest.raises(Exception, match="there already"):
            runlog.keyed_insert(new, old, strict=True).collect()
    assert runlog.keyed_insert(log, log.limit(0), strict=True).count() == log.count()
    spark.range(3).createOrReplaceTempView("runs")
    assert runlog.query(log, "SELECT count(*) AS n FROM {runs} WHERE run_id <> ?", ["r1"]).first().n == log.count() - 1
    assert spark.table("runs").columns == ["id"]  # a view of the session's own stays


def test_keyed_insert_and_export(spark, log, tmp_path):
    new = runlog.keyed_insert(log.unionByName(log), log.where("run_id = 'r1'")).orderBy("run_id").collect()
    assert [(r.run_id, r.runtime_seconds) for r in new] == [("r0", 2.5), ("r2", 2.5), ("r3", None)]
    assert json.loads(new[0].manifest)["task_name"] == "stm"
    assert not runlog.export_csv(log.limit(0), f"{tmp_path}/x") and not os.path.exists(f"{tmp_path}/x")
    assert runlog.export_csv(log.orderBy(F.desc("run_id")), f"{tmp_path}/y")
    assert [r.run_id for r in spark.read.option("header", True).csv(f"{tmp_path}/y").orderBy("timestamp_utc").collect()] == ["r0", "r1", "r2", "r3"]
    assert [r.run_id for r in runlog.query(log, "SELECT run_id FROM {runs} WHERE run_id > ?", ["r1"]).collect()] == ["r2", "r3"]


def test_reports_and_results(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"overall": "FAIL"}')
    (tmp_path / "b.json").write_text('{"overall": "PASS",\n "checks": {"x": "PASS"}}')
    assert runlog.latest_report(spark, str(tmp_path)).first().overall == "PASS"
    (tmp_path / "c.json").write_text("{broken")
    assert runlog.latest_report(spark, str(tmp_path)).count() == 0
    results = spark.createDataFrame([(1, "G1", "FAIL", 1), (1, "G1", "PASS", 2)], "experiment_id long, gate string, verdict string, evaluated_at long")
    runlog.append_gate_results(results, f"{tmp_path}/gates")
    assert [r.verdict for r in runlog.current_gate_results(spark.read.parquet(f"{tmp_path}/gates")).collect()] == ["PASS"]
    runlog.save_features(spark.sql("SELECT 'r' AS run_id, 0L AS t, array(1.0D) AS x"), f"{tmp_path}/features")
    runlog.save_fits(spark.sql("SELECT 'r' AS run_id, 0 AS target_k, array(1.0D) AS coef"), f"{tmp_path}/fits")
    runlog.save_timings(spark.sql("SELECT 'fft' AS name, 5 AS iterations"), f"{tmp_path}/timings")
    assert spark.read.parquet(f"{tmp_path}/features").count() == spark.read.parquet(f"{tmp_path}/fits").count() == spark.read.json(f"{tmp_path}/timings").count() == 1


def test_live_series_out_of_order_equals_batch(spark, tmp_path):
    rows = spark.range(240).selectExpr("id % 2 AS series_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "id", "(id * 37 % 50) / 100.0D AS u", "id div 2 AS t")
    arrivals = [rows.where(f"(id + pmod(id * 7919, 41)) div 50 = {k}") for k in range(6)]  # late by up to 40 minutes
    late = rows.where("id = 3").withColumns({"id": F.lit(999), "u": F.lit(0.4)})  # long after its time
    end = rows.where("id = 0").withColumns({"series_id": F.lit(None).cast("long"), "ts": F.timestamp_seconds(F.lit(1800000000))})
    for part in [*arrivals, late, end]:
        part.select("series_id", "ts", "id", "u").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series_id long, ts timestamp, id long, u double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = live.run_appended(live.live_series(stream, late="45 minutes"), str(tmp_path), "out").collect()
    got = {(r.series_id, r.t): (r.y, r.blend) for r in out}
    assert [r.id for r in sorted(out, key=lambda r: r.t) if r.series_id == 1] == list(range(1, 240, 2))
    y = {(r.series_id, r.t): r.y for r in series.narma_recurrence(rows, "u").collect()}
    blend = {(r.series_id, r.t): r.blend_u for r in series.trailing_blend(rows, 3, ["u"]).collect()}
    assert got.keys() == y.keys() and all(got[k] == pytest.approx((y[k], blend[k])) for k in got)


def test_series_so_far_in_any_pieces():
    u = np.random.default_rng(1).uniform(0, 0.5, 50)
    whole, pieces = live.SeriesSoFar(4), live.SeriesSoFar(4)
    y, blend = whole.add(u)
    parts = [pieces.add(u[a : a + 3]) for a in range(0, 50, 3)]
    assert np.concatenate([p[0] for p in parts]) == pytest.approx(y) and np.concatenate([p[1] for p in parts]) == pytest.approx(blend)


@pytest.mark.parametrize("name", ["lag_matrix", "memory_capacity", "holm", "gate_all", "gate_g5", "running_compute", "stream_totals", "stream_gates", "param_grid", "fold_ids_balanced"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "orders", "customer", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    both = (series_queries.QUERIES | run_queries.QUERIES)[name], (series_queries.ORACLES | run_queries.ORACLES)[name]
    found = con.execute(both[1])
    names = [d[0] for d in found.description]
    text = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(text, r)) for r in found.fetchall())
    assert sorted(tuple(text(r[c]) for c in names) for r in both[0](spark, SF).collect()) == want


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
