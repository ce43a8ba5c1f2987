"""Reading and writing run logs, reports, gate results, features and fits."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatherline.operators.runs import stage_total
from gatherline.sources.schemas import HEALTH, JSON_CELLS, RUN_COLUMNS, RUNS


def complete(runs: DataFrame) -> DataFrame:
    """All log columns in order, those that an older log lacks as typed nulls; further columns follow."""
    own = [F.col(f.name) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUNS]
    return runs.select(*own, *[c for c in runs.columns if c not in RUN_COLUMNS])


def parsed(runs: DataFrame) -> DataFrame:
    """JSON cells to arrays and maps, timestamps (ISO, with offset or Z; bad ones null) and success to types."""
    rows = complete(runs)
    typed = {c: F.from_json(c, kind) for c, kind in JSON_CELLS.items() if rows.schema[c].dataType.simpleString() == "string"}
    typed |= {"timestamp_utc": F.try_to_timestamp("timestamp_utc"), "success": F.lower("success") == "true"} if rows.schema["success"].dataType.simpleString() == "string" else {}
    return rows.withColumns(typed)


def with_json_cells(runs: DataFrame) -> DataFrame:
    """Arrays and maps of the log as JSON text, for text sinks; maps' types stay implied by the column."""
    rows = complete(runs)
    return rows.withColumns({c: F.to_json(c) for c in JSON_CELLS if rows.schema[c].dataType.simpleString() != "string"})


def read_csv_log(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """A CSV run log with header and its JSON cells; without such a file an error, or no rows."""
    try:
        return spark.read.schema(RUNS).option("header", True).option("escape", '"').csv(path)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], RUNS)
        raise


def append_csv_log(runs: DataFrame, path: str) -> None:
    with_json_cells(runs).select(*RUN_COLUMNS).write.mode("append").option("header", True).option("escape", '"').csv(path)


def append_log(runs: DataFrame, path: str) -> None:
    """Append to the Parquet log; one folder a task, so that reads of a task are pruned."""
    complete(runs).write.mode("append").partitionBy("task_name").parquet(path)


def keyed_insert(new: DataFrame, existing: DataFrame, strict: bool = False) -> DataFrame:
    """The rows of ``new`` whose ``run_id`` isn't there yet, once each, with the runtime and the row as JSON.

    Of new rows with one id the least by its JSON stays. ``strict``: an id that is there, or comes twice, raises.
    """
    rows = new.withColumn("manifest", F.to_json(F.struct(*new.columns)))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("run_id").orderBy("manifest")))
    there = existing.select("run_id", F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "run_id", "left")
    again = (F.col("_nth") > 1) | F.coalesce("_there", F.lit(False))
    wanted = ~again
    if strict:
        wanted = F.when(again, F.raise_error(F.concat(F.lit("run_id is there already: "), "run_id")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(wanted).drop("_nth", "_there").withColumn("runtime_seconds", stage_total("runtime_per_stage_seconds"))


def export_csv(runs: DataFrame, path: str) -> bool:
    """All rows by time as CSV with header, in ordered part files; nothing is written for an empty log."""
    if runs.isEmpty():
        return False
    with_json_cells(runs).orderBy("timestamp_utc", "run_id").write.option("header", True).option("escape", '"').csv(path)
    return True


def read_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of each JSON file of a folder, whole; bad JSON is kept as text."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of greatest file name as ``path, overall, timestamp_utc, checks``; none if it can't be read."""
    last = read_json_files(spark, folder).agg(F.max_by(F.struct("path", "text"), "path").alias("r"))
    row = last.select("r.path", F.from_json("r.text", HEALTH).alias("h"), F.json_object_keys("r.text").alias("keys")).where("keys IS NOT NULL")
    return row.select("path", "h.overall", "h.timestamp_utc", "h.checks")


def append_gate_results(results: DataFrame, path: str) -> None:
    """History is kept; see ``current_gate_results``."""
    results.withColumn("evaluated_at", F.current_timestamp() if "evaluated_at" not in results.columns else F.col("evaluated_at")).write.mode("append").parquet(path)


def current_gate_results(results: DataFrame, keys=("experiment_id", "gate")) -> DataFrame:
    own = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*own), "evaluated_at").alias("r")).select(*keys, "r.*")


def save_features(features: DataFrame, path: str, buckets: int = 16) -> None:
    """``run_id, t, x`` in folders by a hash of the run."""
    features.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets))).write.mode("append").partitionBy("bucket").parquet(path)


def save_fits(fits: DataFrame, path: str) -> None:
    fits.write.mode("append").parquet(path)


def save_timings(timings: DataFrame, path: str) -> None:
    timings.write.mode("append").json(path)


def query(runs: DataFrame, sql: str, args: list | None = None) -> DataFrame:
    """A read query over ``{runs}`` with positional parameters; the session's own views stay as they are."""
    name = f"runs_{uuid.uuid4().hex}"
    runs.createTempView(name)
    try:
        return runs.sparkSession.sql(sql.replace("{runs}", name), args=args or [])
    finally:
        runs.sparkSession.catalog.dropTempView(name)
