"""Registered queries of series, scores, features, readouts and inference, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.functions import scoring
from gatherline.operators import blocks, features, inference, readout, series
from gatherline.operators.runs import grid
from gatherline.plans import benchmark
from gatherline.plans import workloads as w
from gatherline.sources import runlog
from gatherline.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


# series and windows


@query(f"WITH {w.SERIES_SQL} SELECT series_id, t, u AS y_0, lag(u, 1, 0.0) OVER w AS y_1, lag(u, 2, 0.0) OVER w AS y_2, lag(u, 3, 0.0) OVER w AS y_3 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)")
def lag_matrix(spark: SparkSession, d: str) -> DataFrame:
    return series.lag_matrix(w.series(spark, d), 3).select("series_id", "t", "y_0", "y_1", "y_2", "y_3")


@query(f"WITH {w.SERIES_SQL} SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.7::DOUBLE) AS is_train FROM series")
def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    return series.chrono_split(w.series(spark, d), 0.7).select("series_id", "t", "is_train")


@query(f"WITH {w.SERIES_SQL} SELECT series_id, t, CASE WHEN t < 2 THEN 0 ELSE bit_xor(b) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS y FROM series")
def rolling_parity(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_parity(w.series(spark, d), 3).select("series_id", "t", "y")


@query(f"WITH {w.SERIES_SQL} SELECT series_id, t, round(0.5 * u + 0.5 * avg(u) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS blend_u FROM series")
def trailing_blend(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing_blend(w.series(spark, d), 3, ["u"]).select("series_id", "t", r6("blend_u", "blend_u"))


NARMA_SQL = f"""WITH RECURSIVE {w.SERIES_SQL}, ins AS (SELECT *, lag(u01, 9) OVER (PARTITION BY series_id ORDER BY t) AS u9 FROM series),
rec(series_id, t, ys) AS (
  SELECT DISTINCT series_id, 9::BIGINT, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0] FROM series
  UNION ALL
  SELECT r.series_id, i.t, list_append(r.ys[2:], 0.3 * r.ys[10] + 0.05 * r.ys[10] * list_sum(r.ys) + 1.5 * i.u9 * i.u01 + 0.1)
  FROM rec r JOIN ins i ON i.series_id = r.series_id AND i.t = r.t + 1)
"""


@query(NARMA_SQL + "SELECT s.series_id, s.t, round(coalesce(CASE WHEN r.t >= 10 THEN r.ys[10] END, 0.0), 6) AS y FROM series s LEFT JOIN rec r ON r.series_id = s.series_id AND r.t = s.t")
def narma_recurrence(spark: SparkSession, d: str) -> DataFrame:
    return series.narma_recurrence(w.series(spark, d)).select("series_id", "t", r6("y", "y"))


@query(NARMA_SQL + """, made AS (
  SELECT s.series_id, s.t, s.u01 AS u, coalesce(CASE WHEN r.t >= 10 THEN r.ys[10] END, 0.0) + CASE WHEN s.series_id % 3 = 0 AND s.t = 30 THEN 0.001 ELSE 0 END AS y
  FROM series s LEFT JOIN rec r ON r.series_id = s.series_id AND r.t = s.t),
c AS (
  SELECT series_id, y, CASE WHEN t < 10 THEN 0.0 ELSE 0.3 * lag(y) OVER w + 0.05 * lag(y) OVER w * sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) + 1.5 * lag(u, 9) OVER w * u + 0.1 END AS e
  FROM made WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, count(*) AS n, count(*) FILTER (abs(y - e) > 1e-12 + 1e-10 * abs(e)) AS bad FROM c GROUP BY series_id""")
def recurrence_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored values that follow the recurrence, but for one in every third series, which spoils those after it."""
    made = series.narma_recurrence(w.series(spark, d))
    spoiled = made.withColumn("y", F.col("y") + F.when((F.col("series_id") % 3 == 0) & (F.col("t") == 30), 0.001).otherwise(0.0))
    return series.recurrence_check(spoiled).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))


@query(f"WITH {w.SERIES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series) SELECT series_id, t, CASE WHEN t // (n // 5) < 5 THEN (t // (n // 5))::INT END AS fold FROM c")
def fold_ids_floor(spark: SparkSession, d: str) -> DataFrame:
    return series.fold_ids(w.series(spark, d), 5, balanced=False).select("series_id", "t", "fold")


@query(f"""WITH {w.SERIES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series)
SELECT series_id, t, (CASE WHEN t < (n % 5) * (n // 5 + 1) THEN t // (n // 5 + 1) ELSE n % 5 + (t - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold FROM c""")
def fold_ids_balanced(spark: SparkSession, d: str) -> DataFrame:
    return series.fold_ids(w.series(spark, d), 5).select("series_id", "t", "fold")


# scores

CORR = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) ELSE 0.0 END"


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round({CORR.format('p', 'y')}, 6) AS r FROM scores GROUP BY series_id, k")
def safe_corr(spark: SparkSession, d: str) -> DataFrame:
    return w.scores(spark, d).groupBy("series_id", "k").agg(r6(scoring.correlation(F.col("p"), F.col("y")), "r"))


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round(power({CORR.format('p', 'y')}, 2), 6) AS r2 FROM scores GROUP BY series_id, k")
def delay_r2(spark: SparkSession, d: str) -> DataFrame:
    return w.scores(spark, d).groupBy("series_id", "k").agg(r6(scoring.r_squared(F.col("p"), F.col("y")), "r2"))


@query(f"WITH {w.SCORES_SQL}, r AS (SELECT series_id, k, power({CORR.format('p', 'y')}, 2) AS r2 FROM scores GROUP BY series_id, k) SELECT series_id, round(sum(r2), 6) AS memory_capacity FROM r GROUP BY series_id")
def memory_capacity(spark: SparkSession, d: str) -> DataFrame:
    each = w.scores(spark, d).groupBy("series_id", "k").agg(scoring.r_squared(F.col("p"), F.col("y")).alias("r2"))
    return each.groupBy("series_id").agg(r6(F.sum("r2"), "memory_capacity"))


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round(sqrt(avg((p - y) * (p - y))) / stddev_pop(y), 6) AS nrmse FROM scores GROUP BY series_id, k")
def nrmse(spark: SparkSession, d: str) -> DataFrame:
    return w.scores(spark, d).groupBy("series_id", "k").agg(r6(scoring.nrmse(F.col("p"), F.col("y")), "nrmse"))


@query(f"WITH {w.SERIES_SQL}, p AS (SELECT series_id, avg(b) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p, b AS y FROM series) SELECT series_id, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM p GROUP BY series_id")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.framed(w.series(spark, d), series.SERIES, ["t"], 4, lambda o: {"p": F.avg("b").over(o.rowsBetween(-4, 0))})
    share = scoring.accuracy(F.col("p"), F.col("b"))
    # scaled before it is rounded, as SQL does: 323 / 640 is half-way between two results
    return rows.groupBy("series_id").agg((F.round(share * 1e6) / 1e6).alias("accuracy"))


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round(avg((p - y) * (p - y)), 6) AS mse FROM scores GROUP BY series_id, k")
def mse(spark: SparkSession, d: str) -> DataFrame:
    return w.scores(spark, d).groupBy("series_id", "k").agg(r6(scoring.mse(F.col("p"), F.col("y")), "mse"))


@query(f"WITH {w.SCORES_SQL} SELECT series_id, k, round(avg(abs(p - y)), 6) AS mae, round(avg((p - y) * (p - y)) / var_pop(y), 6) AS nmse FROM scores GROUP BY series_id, k")
def secondary_scores(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return w.scores(spark, d).groupBy("series_id", "k").agg(r6(scoring.mae(p, y), "mae"), r6(scoring.nmse(p, y), "nmse"))


# features and readouts

_DRAW = "(('0x' || substr(md5({0}), 1, 8))::BIGINT + 0.5) / 4294967296.0"
_U = lambda seed, *keys: _DRAW.format(" || ':' || ".join([f"'{seed}'", *keys]))
_N = lambda seed, *keys: f"sqrt(-2 * ln({_U(seed, *keys, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {_U(seed, *keys, chr(39) + 'a' + chr(39))})"


@query(f"SELECT j::INT AS j, round({_N(137, chr(39) + 'w' + chr(39), 'j')} * 1.0 / 8, 6) AS w, round(2 * pi() * {_U(137, chr(39) + 'b' + chr(39), 'j')}, 6) AS b, count(*) AS n FROM events, range(8) r(j) GROUP BY j")
def rks_params(spark: SparkSession, d: str) -> DataFrame:
    """The parameters of features fitted to the series, with the number of rows that they apply to."""
    n = w.table(spark, d, "events").agg(F.count("*").alias("n"))
    return features.cosine_params(spark, 8).crossJoin(n).select("j", r6("w", "w"), r6("b", "b"), "n")


@query(f"""WITH {w.SERIES_SQL} SELECT series_id, t, j::INT AS j, round(cos({_N(137, chr(39) + 'w' + chr(39), 'j')} * 1.0 / 4 * u + 2 * pi() * {_U(137, chr(39) + 'b' + chr(39), 'j')}), 6) AS x FROM series, range(4) r(j)""")
def rks_features(spark: SparkSession, d: str) -> DataFrame:
    x = features.cosine_features(w.series(spark, d), features.cosine_params(spark, 4))
    return x.select("series_id", "t", F.posexplode("x").alias("j", "x")).select("series_id", "t", "j", r6("x", "x"))


@query(f"""WITH {w.SERIES_SQL} SELECT series_id, t, j::INT AS j, round(cos({_N(137, chr(39) + 'w' + chr(39), 'series_id', 't', 'j')} * 1.0 / 2 * u + 2 * pi() * {_U(137, chr(39) + 'b' + chr(39), 'series_id', 't', 'j')}), 6) AS x FROM series, range(2) r(j)""")
def rks_per_row(spark: SparkSession, d: str) -> DataFrame:
    x = features.cosine_features_per_row(w.series(spark, d), 2)
    return x.select("series_id", "t", F.posexplode("x").alias("j", "x")).select("series_id", "t", "j", r6("x", "x"))


RIDGE_SQL = """WITH f AS (SELECT vec_id % 4 AS series_id, list_sum(embedding[1:32]::DOUBLE[]) AS x1, list_sum(embedding[33:64]::DOUBLE[]) AS x2, (label >= 5)::INT::DOUBLE AS y FROM embeddings),
m AS (SELECT series_id, sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + 0.01 AS a, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS c, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) + 0.01 AS d,
  sum(x1 * y) - sum(x1) * sum(y) / count(*) AS p, sum(x2 * y) - sum(x2) * sum(y) / count(*) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM f GROUP BY series_id),
s AS (SELECT *, (p * d - q * c) / (a * d - c * c) AS w1, (q * a - p * c) / (a * d - c * c) AS w2 FROM m)
SELECT series_id, round(w1, 6) AS w1, round(w2, 6) AS w2, round(my - w1 * m1 - w2 * m2, 6) AS b FROM s"""


@query(RIDGE_SQL)
def ridge_f2(spark: SparkSession, d: str) -> DataFrame:
    half = lambda first: F.aggregate(F.slice("x", first, 32), F.lit(0.0), lambda a, v: a + v)
    rows = w.features(spark, d).select("series_id", half(1).alias("x1"), half(33).alias("x2"), "y")
    return readout.ridge_two(rows, 0.01).select("series_id", r6("w1", "w1"), r6("w2", "w2"), r6("b", "b"))


@query(RIDGE_SQL)
def saved_fits(spark: SparkSession, d: str) -> DataFrame:
    """The fits of ``ridge_f2``, saved in two parts and read back."""
    at, fits = scratch(spark), ridge_f2(spark, d)
    runlog.save_fits(fits.where("series_id < 2"), at)
    runlog.save_fits(fits.where("series_id >= 2"), at)
    return spark.read.parquet(at)


@query(f"""WITH {w.SERIES_SQL}, x AS (SELECT series_id, j::INT AS j, cos({_N(137, chr(39) + 'w' + chr(39), 'j')} * 1.0 / 4 * u + 2 * pi() * {_U(137, chr(39) + 'b' + chr(39), 'j')}) AS x FROM series, range(4) r(j))
SELECT series_id::VARCHAR AS run_id, j, count(*) AS n, round(sum(x), 6) AS total FROM x GROUP BY ALL""")
def saved_features(spark: SparkSession, d: str) -> DataFrame:
    """Cosine features of each series as a run, saved by hashed run and read back."""
    at = scratch(spark)
    x = features.cosine_features(w.series(spark, d), features.cosine_params(spark, 4))
    runlog.save_features(x.select(F.col("series_id").cast("string").alias("run_id"), "t", "x"), at)
    back = spark.read.parquet(at).select("run_id", F.posexplode("x").alias("j", "x"))
    return back.groupBy("run_id", "j").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


@query()
def ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = series.fold_ids(w.features(spark, d), 5).select("series_id", "fold", "x", F.array("y").alias("y"))
    return readout.ridge_cv(rows).select("series_id", "target_k", "alpha", r6("intercept", "intercept"), F.transform("coef", lambda c: F.round(c, 6)).alias("coef"))


@query()
def rks_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = w.series(spark, d)
    return benchmark.run_task(rows, "narma", features.leaky_features(rows), control="random_features").drop("failure_reason")


def _leaky_sql(units: int = 8, leak: float = 0.3) -> str:
    """States by recursion over the same weights, given as numbers."""
    m, v = features.leaky_weights(units, 0.9, 0.5, 137)
    pull = [f"{1 - leak} * r.s[{i + 1}] + {leak} * tanh(" + " + ".join(f"{x!r} * r.s[{j + 1}]" for j, x in enumerate(m[i].tolist())) + f" + {float(v[i])!r} * i.u01)" for i in range(units)]
    zero = ", ".join(["0.0::DOUBLE"] * units)
    return f"""WITH RECURSIVE {w.SERIES_SQL}, rec(series_id, t, s) AS (
  SELECT DISTINCT series_id, -1::BIGINT, [{zero}] FROM series
  UNION ALL SELECT r.series_id, i.t, [{", ".join(pull)}] FROM rec r JOIN series i ON i.series_id = r.series_id AND i.t = r.t + 1)
SELECT series_id, t, (j - 1)::INT AS j, round(s[j], 6) AS x FROM rec, range(1, {units + 1}) k(j) WHERE t >= 0"""


@query(_leaky_sql())
def leaky_features(spark: SparkSession, d: str) -> DataFrame:
    x = features.leaky_features(w.series(spark, d))
    return x.select("series_id", "t", F.posexplode("x").alias("j", "x")).select("series_id", "t", "j", r6("x", "x"))


def _narma(spark: SparkSession, d: str) -> DataFrame:
    return series.narma_recurrence(w.series(spark, d))


def _grid(spark: SparkSession) -> DataFrame:
    """The configured grid: 60 configurations."""
    return grid(spark, spectral_radius=(0.8, 0.9, 0.95, 0.99, 1.0), input_scaling=(0.1, 0.5, 1.0), leak_rate=(0.1, 0.3, 0.5, 1.0))


@query()
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    return readout.grid_search(_narma(spark, d), _grid(spark))


@query()
def refit_best(spark: SparkSession, d: str) -> DataFrame:
    rows = _narma(spark, d)
    train = series.chrono_split(rows, 0.7).where("is_train").drop("is_train")
    return readout.refit_best(rows, readout.best_config(readout.grid_search(train, _grid(spark))).drop("score"))


@query()
def benchmark_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = w.series(spark, d)
    done = [benchmark.run_task(rows, task) for task in ("stm", "parity", "narma")] + [benchmark.run_leaky(rows, grid=_grid(spark))]
    return done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])


@query()
def control_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = w.series(spark, d)
    return benchmark.run_task(rows, "stm", control="random_features").unionByName(benchmark.run_task(rows, "stm", control="phase_random"))


# inference

#: The two-sided tail of Student's t for whole degrees of freedom, as finite sums.
T_P = """(1 - CASE WHEN df % 2 = 1
  THEN 2 / pi() * (atan(abs(t) / sqrt(df)) + CASE WHEN df = 1 THEN 0 ELSE sin(atan(abs(t) / sqrt(df))) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * power(cos(atan(abs(t) / sqrt(df))), 2 * k + 1))) END)
  ELSE sin(atan(abs(t) / sqrt(df))) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power(cos(atan(abs(t) / sqrt(df))), 2 * k))) END)"""
T_SQL = f"""{w.PAIRS_SQL}, tests AS (
  SELECT grp, count(*) AS n, avg(a - b) AS mean_diff, stddev_samp(a - b) AS std_diff, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, avg(a - b) / stddev_samp(a - b) AS d, count(*) - 1 AS df
  FROM pairs GROUP BY grp HAVING count(*) > 2), tested AS (SELECT *, {T_P} AS p FROM tests)"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return inference.paired(w.pairs(spark, d)).where("n > 2")


@query(f"WITH {T_SQL} SELECT grp, n, round(mean_diff, 6) AS mean_diff, round(std_diff, 6) AS std_diff, round(t, 6) AS t, round(p, 6) AS p, round(d, 6) AS d FROM tested")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("grp", "n", *[r6(c, c) for c in ("mean_diff", "std_diff", "t", "p", "d")])


@query(f"WITH {T_SQL} SELECT grp, round(CASE WHEN mean_diff > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_one_sided FROM tested")
def paired_t_one_sided(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("grp", r6(inference.one_sided(F.col("mean_diff"), F.col("p")), "p_one_sided"))


@query(f"""WITH {T_SQL}, s AS (SELECT grp, grp % 3 AS family, p, (count(*) OVER (PARTITION BY grp % 3) - row_number() OVER (PARTITION BY grp % 3 ORDER BY p) + 1) * p AS scaled FROM tested)
SELECT grp, family, round(least(1.0, max(scaled) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM s""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    return inference.holm(_tests(spark, d).withColumn("family", F.col("grp") % 3)).select("grp", "family", r6("adjusted", "adjusted"))


@query(f"WITH {T_SQL} SELECT grp, CASE WHEN abs(d) > 0 THEN ceil(power(2.8015852182813464 / abs(d), 2))::BIGINT END AS pairs_needed FROM tested")
def power(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("grp", inference.sample_size(F.abs("d")).alias("pairs_needed"))


@query(f"""WITH {w.PAIRS_SQL}, r AS (SELECT grp, a - b AS d, rank() OVER (PARTITION BY grp ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY grp, abs(a - b)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY grp, abs(a - b)) AS c FROM pairs WHERE a <> b),
s AS (SELECT grp, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS statistic, sum(c * c - 1) AS ties FROM r GROUP BY grp)
SELECT grp, n, round(statistic::DOUBLE, 6) AS statistic, round((statistic - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0), 6) AS z FROM s""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return inference.wilcoxon(w.pairs(spark, d)).select("grp", "n", r6("statistic", "statistic"), r6("z", "z"))


def phi_sql(z: str) -> str:
    """The normal distribution function as its series."""
    terms = f"list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs({z})) + 0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5))))"
    return f"(CASE WHEN ({z}) = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms} END)"


def ppf_sql(p: str) -> str:
    """Its inverse by Newton's steps from 0."""
    return f"list_reduce(list_transform(range(0, 60), lambda i: i::DOUBLE), lambda z, i: z - ({phi_sql('z')} - {p}) * sqrt(2 * pi()) * exp(z * z / 2), 0.0::DOUBLE)"


@query(f"""WITH RECURSIVE {w.PAIRS_SQL}, r AS (SELECT grp, a - b AS d, rank() OVER (PARTITION BY grp ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY grp, abs(a - b)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY grp, abs(a - b)) AS c FROM pairs WHERE a <> b),
s AS (SELECT grp, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS statistic, sum(c * c - 1) AS ties FROM r GROUP BY grp),
ways(k, w) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1), lambda i: coalesce(w[i + 1], 0) + CASE WHEN i > k THEN coalesce(w[i - k], 0) ELSE 0 END) FROM ways WHERE k < 50),
z AS (SELECT *, abs(statistic - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0) AS z FROM s)
SELECT grp, n, round(CASE WHEN n <= 50 AND ties = 0 THEN least(1.0, 2 * list_sum(w[1:floor(statistic)::INT + 1]) / power(2, n)) ELSE 2 * (1 - {phi_sql("z")}) END, 6) AS p FROM z LEFT JOIN ways ON k = n""")
def wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    return inference.wilcoxon(w.pairs(spark, d)).select("grp", "n", r6("p", "p"))


#: 1000 resamples of ``pairs(grp, pair_id, a, b)``: the same draws, four from each md5.
BOOT_SQL = """xs AS (SELECT grp, list(a - b ORDER BY pair_id) AS xs, avg(a - b) AS effect FROM pairs GROUP BY grp),
boot AS (
  SELECT grp, effect, list_sum(list_transform(range(0, len(xs)), lambda i: xs[(('0x' || substr(md5('42:' || grp || ':' || b || ':' || (i // 4)), 8 * (i % 4) + 1, 8))::BIGINT % len(xs)) + 1])) / len(xs) AS m
  FROM xs, range(1, 1001) r(b))"""
BCA_SQL = f"""dev AS (SELECT grp, len(xs) AS n, effect, unnest(xs) - effect AS c FROM xs),
jack AS (SELECT grp, n, effect, coalesce(sum(c * c * c) / nullif(6 * power(sum(c * c), 1.5), 0), 0) AS accel FROM dev GROUP BY grp, n, effect),
means AS (SELECT grp, list_sort(list(m)) AS ms, greatest(least(count(*) FILTER (m < effect) / count(*), 1 - 1e-10), 1e-10)::DOUBLE AS share FROM boot GROUP BY grp),
bias AS (SELECT j.*, ms, {ppf_sql("share")} AS z0 FROM jack j JOIN means ON means.grp = j.grp),
tails AS (SELECT *, z0 - 1.959963984540054 AS zl, z0 + 1.959963984540054 AS zh FROM bias),
args AS (SELECT *, z0 + zl / (1 - accel * zl) AS al, z0 + zh / (1 - accel * zh) AS ah FROM tails),
ends AS (SELECT *, {phi_sql("al")} * (len(ms) - 1) AS pl, {phi_sql("ah")} * (len(ms) - 1) AS ph FROM args),
bca AS (SELECT grp, n, effect AS mean, """ + ", ".join(f"CASE WHEN n >= 3 THEN ms[floor({p})::INT + 1] + ({p} - floor({p})) * (coalesce(ms[floor({p})::INT + 2], ms[floor({p})::INT + 1]) - ms[floor({p})::INT + 1]) END AS {name}" for p, name in (("pl", "low"), ("ph", "high"))) + " FROM ends)"


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return w.pairs(spark, d).select("grp", "pair_id", (F.col("a") - F.col("b")).alias("x"))


@query(f"WITH {w.PAIRS_SQL}, {BOOT_SQL} SELECT grp, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM boot GROUP BY grp")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return inference.bootstrap_ci(_differences(spark, d)).select("grp", r6("low", "low"), r6("high", "high"))


@query(f"WITH {w.PAIRS_SQL}, {BOOT_SQL}, {BCA_SQL} SELECT grp, n, round(mean, 6) AS mean, round(low, 4) AS low, round(high, 4) AS high FROM bca")
def bca_ci(spark: SparkSession, d: str) -> DataFrame:
    return inference.bca_ci(_differences(spark, d)).select("grp", "n", r6("mean", "mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"WITH {w.SERIES_SQL} SELECT series_id, round(quantile_cont(u, 0.05), 6) AS p05, round(quantile_cont(u, 0.5), 6) AS p50, round(quantile_cont(u, 0.95), 6) AS p95 FROM series GROUP BY series_id")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = blocks.quantiles(w.series(spark, d), ["series_id"], "u", [0.05, 0.5, 0.95])
    return q.select("series_id", *[r6(F.col("q")[i], n) for i, n in enumerate(("p05", "p50", "p95"))])


# all events as one series, over blocks

#: Rows of a block, so that small tables have several.
BLOCK = 2_000


@query(f"WITH {w.ONE_SERIES_SQL} SELECT t, u AS y_0, " + ", ".join(f"lag(u, {k}, 0.0) OVER w AS y_{k}" for k in range(1, 9)) + " FROM one_series WINDOW w AS (ORDER BY t)")
def long_lag_matrix(spark: SparkSession, d: str) -> DataFrame:
    return series.lag_matrix(w.one_series(spark, d), 8, block_rows=BLOCK).select("t", *[f"y_{k}" for k in range(9)])


@query(f"WITH {w.ONE_SERIES_SQL} SELECT t, CASE WHEN row_number() OVER (ORDER BY t) < 5 THEN 0 ELSE bit_xor(b) OVER (ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS y FROM one_series")
def long_rolling_parity(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_parity(w.one_series(spark, d), 5, block_rows=BLOCK).select("t", "y")


@query(f"WITH {w.ONE_SERIES_SQL} SELECT t, round(0.5 * u + 0.5 * avg(u) OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS blend_u FROM one_series")
def long_trailing_blend(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing_blend(w.one_series(spark, d), 20, ["u"], block_rows=BLOCK).select("t", r6("blend_u", "blend_u"))


@query(f"WITH {w.ONE_SERIES_SQL}, p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM one_series) SELECT t, (CASE WHEN i < n % 7 * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - n % 7 * (n // 7 + 1)) // (n // 7) END)::INT AS fold, i < floor(n * 0.7::DOUBLE) AS is_train FROM p")
def long_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = series.fold_ids(w.one_series(spark, d), 7, block_rows=BLOCK)
    return series.chrono_split(rows, 0.7, block_rows=BLOCK).select("t", "fold", "is_train")


@query(f"WITH {w.ONE_SERIES_SQL}, d AS (SELECT round(u) - 90 AS d FROM one_series WHERE round(u) <> 90), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM d) SELECT count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS statistic, sum(c * c - 1)::BIGINT AS ties FROM r")
def long_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    pairs = w.one_series(spark, d).select("series_id", F.round("u").alias("a"), F.lit(90.0).alias("b"))
    return inference.wilcoxon(pairs, ["series_id"], block_rows=50).select("n", "statistic", "ties")


@query(f"WITH {w.ONE_SERIES_SQL} SELECT round(quantile_cont(u, 0.01), 6) AS p01, round(quantile_cont(u, 0.5), 6) AS p50, round(quantile_cont(u, 0.999), 6) AS p999 FROM one_series")
def long_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = blocks.quantiles(w.one_series(spark, d), ["series_id"], "u", [0.01, 0.5, 0.999], block_rows=BLOCK)
    return q.select(*[r6(F.col("q")[i], n) for i, n in enumerate(("p01", "p50", "p999"))])


@query("""WITH RECURSIVE one AS (SELECT event_id AS t, row_number() OVER (ORDER BY event_id) - 1 AS i, least(value, 500.0) / 1000 AS u FROM events),
ins AS (SELECT i, t, u, lag(u, 9) OVER (ORDER BY i) AS u9 FROM one),
rec(i, ys) AS (
  SELECT 9::BIGINT, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0]
  UNION ALL SELECT n.i, list_append(r.ys[2:], 0.3 * r.ys[10] + 0.05 * r.ys[10] * list_sum(r.ys) + 1.5 * n.u9 * n.u + 0.1) FROM rec r JOIN ins n ON n.i = r.i + 1)
SELECT one.t, round(coalesce(rec.ys[10], 0.0), 6) AS y FROM one LEFT JOIN rec ON rec.i = one.i""")
def long_narma(spark: SparkSession, d: str) -> DataFrame:
    return series.narma_recurrence(w.one_series(spark, d), block_rows=BLOCK).select("t", r6("y", "y"))


# cross-validated ridge on two features, where SQL can say it

#: Alphas far apart, so that rounding chooses none.
TWO_ALPHAS = (1e-2, 1.0, 1e3, 1e5)
RIDGE_CV_SQL = """WITH f AS (SELECT vec_id % 4 AS series_id, vec_id AS t, list_sum(embedding[1:32]::DOUBLE[]) AS x1, list_sum(embedding[33:64]::DOUBLE[]) AS x2, (label >= 5)::INT::DOUBLE AS y FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS m FROM f),
g AS (SELECT *, CASE WHEN i < m % 5 * (m // 5 + 1) THEN i // (m // 5 + 1) ELSE m % 5 + (i - m % 5 * (m // 5 + 1)) // (m // 5) END AS fold FROM p),
s AS (SELECT series_id, fold, count(*) AS n, sum(x1) AS a, sum(x2) AS b, sum(y) AS c, sum(x1 * x1) AS aa, sum(x1 * x2) AS ab, sum(x2 * x2) AS bb, sum(x1 * y) AS ac, sum(x2 * y) AS bc, sum(y * y) AS cc FROM g GROUP BY ALL),
w AS (SELECT series_id, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ac) AS ac, sum(bc) AS bc FROM s GROUP BY ALL),
sets AS (SELECT w.series_id, fold, w.n - s.n AS n, w.a - s.a AS a, w.b - s.b AS b, w.c - s.c AS c, w.aa - s.aa AS aa, w.ab - s.ab AS ab, w.bb - s.bb AS bb, w.ac - s.ac AS ac, w.bc - s.bc AS bc FROM w JOIN s ON s.series_id = w.series_id
  UNION ALL SELECT series_id, NULL, n, a, b, c, aa, ab, bb, ac, bc FROM w),
m AS (SELECT series_id, fold, alpha, n, a, b, c, aa - a * a / n + alpha AS p, ab - a * b / n AS q, bb - b * b / n + alpha AS r, ac - a * c / n AS u, bc - b * c / n AS v FROM sets, (VALUES """ + ", ".join(f"({x!r}::DOUBLE)" for x in TWO_ALPHAS) + """) al(alpha)),
fit AS (SELECT *, (c - w1 * a - w2 * b) / n AS w0 FROM (SELECT *, (u * r - v * q) / (p * r - q * q) AS w1, (v * p - u * q) / (p * r - q * q) AS w2 FROM m)),
held AS (SELECT f.series_id, f.alpha, 1 - (s.cc - 2 * (w1 * s.ac + w2 * s.bc) - 2 * w0 * s.c + w1 * w1 * s.aa + 2 * w1 * w2 * s.ab + w2 * w2 * s.bb + 2 * w0 * (w1 * s.a + w2 * s.b) + s.n * w0 * w0) / (s.cc - s.c * s.c / s.n) AS r2
  FROM fit f JOIN s ON s.series_id = f.series_id AND s.fold = f.fold),
best AS (SELECT series_id, arg_max(alpha, {'r2': r2, 'first': -alpha}) AS alpha FROM (SELECT series_id, alpha, avg(r2) AS r2 FROM held GROUP BY ALL) GROUP BY series_id),
chosen AS (SELECT f.series_id, f.alpha, w0, w1, w2 FROM fit f JOIN best ON best.series_id = f.series_id AND best.alpha = f.alpha WHERE f.fold IS NULL)
"""


def _two_features(spark: SparkSession, d: str) -> DataFrame:
    half = lambda first: F.aggregate(F.slice("x", first, 32), F.lit(0.0), lambda a, v: a + v)
    return w.features(spark, d).select("series_id", "t", F.array(half(1), half(33)).alias("x"), F.array("y").alias("y"))


@query(RIDGE_CV_SQL + "SELECT series_id, alpha, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM chosen")
def ridge_cv_f2(spark: SparkSession, d: str) -> DataFrame:
    rows = series.fold_ids(_two_features(spark, d), 5).select("series_id", "fold", "x", "y")
    return readout.ridge_cv(rows, TWO_ALPHAS).select("series_id", "alpha", r6("intercept", "w0"), r6(F.col("coef")[0], "w1"), r6(F.col("coef")[1], "w2"))


@query(RIDGE_CV_SQL + "SELECT f.series_id, t, round(w0 + w1 * x1 + w2 * x2, 6) AS p, y FROM f JOIN chosen ON chosen.series_id = f.series_id")
def ridge_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_features(spark, d)
    fits = readout.ridge_cv(series.fold_ids(rows, 5).select("series_id", "fold", "x", "y"), TWO_ALPHAS)
    return readout.predict(rows, fits).select("series_id", "t", r6("p", "p"), "y")
