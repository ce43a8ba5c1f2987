"""Series, runs and pairs as views over the test tables, each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user: ``series_id, t, u, u01, b``; ``u01`` lies in [0, 0.5]; null times come last, as in SQL."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).cast("bigint").alias("t"), F.col("value").alias("u"),
        (F.least(F.col("value"), F.lit(500.0)) / 1000).alias("u01"), F.col("event_type").isin("purchase", "error").cast("int").alias("b"),
    )


SERIES_SQL = """series AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS u,
         least(value, 500.0) / 1000 AS u01, (event_type IN ('purchase', 'error'))::INT AS b FROM events)"""


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, by ``event_id``: ``series_id, t, u, u01, b``."""
    return table(spark, sf_dir, "events").select(F.lit(0).alias("series_id"), F.col("event_id").alias("t"), F.col("value").alias("u"), (F.least(F.col("value"), F.lit(500.0)) / 1000).alias("u01"), F.col("event_type").isin("purchase", "error").cast("int").alias("b"))


ONE_SERIES_SQL = "one_series AS (SELECT 0 AS series_id, event_id AS t, value AS u, (event_type IN ('purchase', 'error'))::INT AS b FROM events)"


def scores(spark: SparkSession, sf_dir: str, delay_max: int = 3) -> DataFrame:
    """``series_id, t, k, p, y``: the trailing mean of five values as prediction of the value k steps back."""
    w = Window.partitionBy("series_id").orderBy("t")
    rows = series(spark, sf_dir).withColumn("p", F.avg("u").over(w.rowsBetween(-4, 0)))
    rows = rows.withColumns({f"y_{k}": F.lag("u", k, 0.0).over(w) if k else F.col("u") for k in range(delay_max + 1)})
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"y_{k}").alias("y")) for k in range(delay_max + 1)])
    return rows.select("series_id", "t", "p", F.explode(lags).alias("e")).select("series_id", "t", "e.k", "p", "e.y")


SCORES_SQL = SERIES_SQL + """, scores AS (
  SELECT series_id, t, k, avg(u) OVER (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p,
         CASE k WHEN 0 THEN u WHEN 1 THEN lag(u, 1, 0.0) OVER w WHEN 2 THEN lag(u, 2, 0.0) OVER w ELSE lag(u, 3, 0.0) OVER w END AS y
  FROM series, (VALUES (0), (1), (2), (3)) AS ks(k) WINDOW w AS (PARTITION BY series_id, k ORDER BY t))"""

#: Task by order priority, for the two mappings of the runs view.
TASKS = {False: ("stm", "ablation:no_entangle", "esn", "ablation:haar", "parity"), True: ("narma", "esn_narma", "ablation:random_features", "ablation:phase_random", "parity")}


def runs(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """A run log of 23 columns: an order is a run, a nation an experiment."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    names = TASKS[second]
    task = F.element_at(F.array(*map(F.lit, names)), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = rows.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("c_nationkey").alias("experiment_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp_utc"), task.alias("task_name"), F.col("o_orderstatus").alias("backend_device"), (F.col("o_orderkey") % 10 != 0).alias("success"), "o_totalprice", "o_orderkey", "o_custkey")
    metric = F.when(F.col("task_name") == "parity", "accuracy").when(F.col("task_name").contains("narma"), "nrmse").otherwise("mc") if not second else F.when(F.col("task_name").isin("parity", "ablation:random_features"), "accuracy").otherwise("nrmse")
    value = F.when(metric == "accuracy", F.col("o_totalprice") / 500000).otherwise(F.col("o_totalprice") / 100000)
    at = F.row_number().over(Window.partitionBy("experiment_id", "task_name").orderBy("timestamp_utc", "run_id"))
    return rows.select(
        "run_id", "experiment_id", "timestamp_utc", "task_name", metric.alias("primary_metric_name"), value.alias("primary_metric_value"), "backend_device", "success",
        (42 + at).cast("bigint").alias("task_seed"), (137 + at).cast("bigint").alias("reservoir_seed"),
        F.sha2(F.concat_ws(":", F.col("experiment_id").cast("string"), "backend_device"), 256).alias("circuit_hash"),
        F.concat(F.lit("configs/"), F.col("task_name"), F.lit(".yaml")).alias("config_path"), F.sha2(F.concat_ws(":", "task_name", (F.col("o_custkey") % 2).cast("string")), 256).alias("config_hash"),
        F.create_map(F.lit("fit"), F.col("o_totalprice") / 1000, F.lit("score"), F.col("o_totalprice") / 4000).alias("stages"),
    )


def runs_sql(second: bool = False) -> str:
    names = ", ".join(f"'{n}'" for n in TASKS[second])
    metric = "CASE WHEN task_name IN ('parity', 'ablation:random_features') THEN 'accuracy' ELSE 'nrmse' END" if second else "CASE WHEN task_name = 'parity' THEN 'accuracy' ELSE 'mc' END"
    return f"""base AS (
  SELECT o_orderkey::VARCHAR AS run_id, c_nationkey AS experiment_id, o_orderdate AS timestamp_utc, [{names}][substr(o_orderpriority, 1, 1)::INT] AS task_name,
         o_orderstatus AS backend_device, o_orderkey % 10 <> 0 AS success, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
runs AS (
  SELECT *, {metric} AS primary_metric_name, CASE WHEN {metric} = 'accuracy' THEN o_totalprice / 500000 ELSE o_totalprice / 100000 END AS primary_metric_value,
         42 + row_number() OVER w AS task_seed, 137 + row_number() OVER w AS reservoir_seed, sha256(experiment_id || ':' || backend_device) AS circuit_hash,
         'configs/' || task_name || '.yaml' AS config_path, sha256(task_name || ':' || (o_custkey % 2)) AS config_hash,
         o_totalprice / 1000 AS fit, o_totalprice / 4000 AS score
  FROM base WINDOW w AS (PARTITION BY experiment_id, task_name ORDER BY timestamp_utc, run_id))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grp, pair_id, a, b``: a customer's mean price of finished and of open orders, by nation."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    per = orders.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(mean("F").alias("a"), mean("O").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("grp"), F.col("o_custkey").alias("pair_id"), "a", "b")


PAIRS_SQL = """pairs AS (
  SELECT c_nationkey AS grp, o_custkey AS pair_id, a, b FROM (
    SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey)
  JOIN customer ON o_custkey = c_custkey WHERE a IS NOT NULL AND b IS NOT NULL)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, t, x, y``: a whole embedding, and whether its label is 5 or more."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") % 4).alias("series_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("double").alias("y"))
