"""Windows, scores, features and readouts: hand-computed facts and NumPy comparisons."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.functions import scoring
from gatherline.operators import charts, features, quality, readout, runs, series
from gatherline.plans import benchmark


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    rows = [(s, t, float(rng.uniform(0, 0.5)), int(rng.integers(0, 2))) for s in range(3) for t in range(100)]
    return spark.createDataFrame(rows, "series_id long, t long, u double, b int").withColumn("u01", F.col("u")).repartition(7)


def by_series(df, *cols):
    out = {}
    for r in df.orderBy("series_id", "t").collect():
        out.setdefault(r.series_id, []).append(tuple(r[c] for c in cols))
    return {k: np.array(v, float) for k, v in out.items()}


def test_lags_and_split(table):
    out = series.chrono_split(series.lag_matrix(table, 5), 0.7)
    for v in by_series(out, "u", "y_0", "y_1", "y_5", "is_train").values():
        u = v[:, 0]
        assert (v[:, 1] == u).all() and (v[1:, 2] == u[:-1]).all() and v[0, 2] == 0 and (v[5:, 3] == u[:-5]).all() and (v[:5, 3] == 0).all()
        assert v[:, 4].sum() == 70 and v[:70, 4].all()


def test_parity_and_blend(table):
    for v in by_series(series.rolling_parity(table, 3), "b", "y").values():
        b = v[:, 0].astype(int)
        assert (v[:2, 1] == 0).all() and all(v[t, 1] == b[t] ^ b[t - 1] ^ b[t - 2] for t in range(2, 100))
    for v in by_series(series.trailing_blend(table, 3, ["u"]), "u", "blend_u").values():
        assert np.allclose(v[:, 1], [0.5 * v[t, 0] + 0.5 * v[max(0, t - 3) : t + 1, 0].mean() for t in range(100)])
    with pytest.raises(ValueError):
        series.trailing_blend(table, 0, ["u"])


def test_recurrence(table):
    made = series.narma_recurrence(table)
    for v in by_series(made, "u", "y").values():
        u, y = v[:, 0], np.concatenate([[0], v[:, 1]])
        assert (y[:11] == 0).all()
        assert all(math.isclose(y[t + 1], 0.3 * y[t] + 0.05 * y[t] * y[t - 9 : t + 1].sum() + 1.5 * u[t - 9] * u[t] + 0.1) for t in range(10, 100))
    assert series.recurrence_check(made).where("bad").count() == 0
    off = made.withColumn("y", F.when(F.col("t") == 50, F.col("y") + 1e-6).otherwise(F.col("y")))
    assert {r.t for r in series.recurrence_check(off).where("bad").collect()} == set(range(50, 61))
    with pytest.raises(Exception, match=r"0, 0.5"):
        series.narma_recurrence(table.withColumn("u01", F.lit(0.7))).collect()


def test_folds(spark):
    rows = spark.createDataFrame([(0, t) for t in range(13)], "series_id long, t long")
    assert list(by_series(series.fold_ids(rows, 3), "fold")[0][:, 0]) == [0] * 5 + [1] * 4 + [2] * 4
    assert [r.fold for r in series.fold_ids(rows, 3, balanced=False).orderBy("t").collect()] == [0] * 4 + [1] * 4 + [2] * 4 + [None]


def test_scores(spark):
    one = lambda rows, agg: spark.createDataFrame(rows, "p double, y double").agg(agg.alias("v")).first().v
    p, y = F.col("p"), F.col("y")
    assert one([(1.0, float(t)) for t in range(50)], scoring.correlation(p, y)) == 0.0
    assert one([(float(t), float(t)) for t in range(50)], scoring.r_squared(p, y)) == pytest.approx(1.0)
    assert one([(0.1, 0.0), (0.9, 1.0), (0.2, 0.0), (0.8, 1.0)], scoring.accuracy(p, y)) == 1.0
    assert one([(0.9, 0.0), (0.1, 1.0), (0.8, 0.0), (0.2, 1.0)], scoring.accuracy(p, y)) == 0.0
    assert one([(1.0, 1.0), (2.0, 1.0)], scoring.nrmse(p, y)) is None
    with pytest.raises(Exception, match="zero variance"):
        one([(1.0, 1.0), (2.0, 1.0)], scoring.nrmse(p, y, strict=True))
    assert one([(1.0, 2.0), (3.0, 2.0), (2.0, 5.0)], scoring.nrmse(p, y)) == pytest.approx(math.sqrt(11 / 3) / np.std([2, 2, 5]))
    with pytest.raises(Exception, match="non-finite"):
        one([(math.nan, 1.0)], F.max(scoring.require_finite(p, "p")))
    for score in (scoring.r_squared, scoring.nrmse, scoring.accuracy):
        with pytest.raises(Exception, match="non-finite"):
            one([(math.nan, 1.0), (0.5, 0.0)], score(p, y))
        with pytest.raises(Exception, match="non-finite"):
            one([(0.5, math.inf), (0.5, 0.0)], score(p, y))
        one([(math.nan, 1.0), (0.5, 0.0)], score(p, y, guarded=False))
    perfect = spark.createDataFrame([(k, float((t * (k + 3)) % 17), float((t * (k + 3)) % 17)) for k in range(5) for t in range(100)], "k int, p double, y double")
    assert perfect.groupBy("k").agg(scoring.r_squared(p, y).alias("r")).agg(F.sum("r")).first()[0] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        charts.metric_correlation(perfect, ["p"])


def test_cosine_features(spark, table):
    params = features.cosine_params(spark, 4, sigma=2.0)
    rows = params.orderBy("j").collect()
    assert all(0 <= r.b <= 2 * math.pi for r in rows)
    wide = np.array([r.w for r in features.cosine_params(spark, 4000, sigma=4000.0).collect()])
    assert abs(wide.mean()) < 0.06 and abs(wide.std() - 1) < 0.05
    for r in features.cosine_features(table, params).limit(20).collect():
        assert np.allclose(r.x, [math.cos(q.w * r.u + q.b) for q in rows])
    per_row = features.cosine_features_per_row(table, 2)
    assert quality.same_rows(per_row, features.cosine_features_per_row(table, 2)) and per_row.select("x").distinct().count() > 290


def brute_ridge(x, y, fold, alphas, k):
    def fit(x, y, a):
        xm, ym = x.mean(0), y.mean(0)
        w = np.linalg.solve((x - xm).T @ (x - xm) + a * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
        return w, ym - xm @ w

    def r2(x, y, w, b):
        return 1 - ((y - x @ w - b) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)

    scores = [np.mean([r2(x[fold == f], y[fold == f], *fit(x[fold != f], y[fold != f], a)).mean() for f in range(k)]) for a in alphas]
    a = alphas[int(np.argmax(scores))]
    return a, *fit(x, y, a)


def test_ridge_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(2, 60, 4)), rng.normal(size=(2, 60, 2))
    y = x @ rng.normal(size=(4, 2)) + 2 * noise + 1
    rows = spark.createDataFrame([(s, t, x[s, t].tolist(), y[s, t].tolist()) for s in range(2) for t in range(60)], "series_id long, t long, x array<double>, y array<double>").repartition(5)
    folded = series.fold_ids(rows, 4)
    fits = readout.ridge_cv(folded)
    for s in range(2):
        alpha, w, b = brute_ridge(x[s], y[s], np.arange(60) // 15, readout.ALPHAS, 4)
        for r in fits.where(F.col("series_id") == s).collect():
            assert r.alpha == alpha and np.allclose(r.coef, w[:, r.target_k]) and r.intercept == pytest.approx(b[r.target_k])
    p = {(r.series_id, r.t, r.k): (r.p, r.y) for r in readout.predict(rows, fits).collect()}
    alpha, w, b = brute_ridge(x[1], y[1], np.arange(60) // 15, readout.ALPHAS, 4)
    assert p[1, 7, 1] == pytest.approx((x[1, 7] @ w[:, 1] + b[1], y[1, 7, 1]))
    two = readout.ridge_two(rows.select("series_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), F.col("y")[0].alias("y")), 0.5).where("series_id = 0").first()
    xc = x[0, :, :2] - x[0, :, :2].mean(0)
    assert np.allclose([two.w1, two.w2], np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ (y[0, :, 0] - y[0, :, 0].mean())))


def test_grid_search_and_best(spark, table):
    grid = runs.grid(spark, spectral_radius=(0.5, 0.9), input_scaling=(1.0,), leak_rate=(0.3, 1.0))
    assert [(r.spectral_radius, r.leak_rate, r.grid_pos) for r in grid.orderBy("grid_pos").collect()] == [(0.5, 0.3, 0), (0.5, 1.0, 1), (0.9, 0.3, 2), (0.9, 1.0, 3)]
    rows = series.narma_recurrence(table.where("series_id = 0"))
    scores = readout.grid_search(rows, grid, units=4)
    got = {r.grid_pos: r.score for r in scores.collect()}
    v = by_series(rows, "u", "y")[0]
    w, inputs = features.leaky_weights(4, 0.9, 1.0, 137)
    want = []
    for f in range(3):  # a plain loop: the rows outside the fold from a zero state, then on into the fold
        val = list(range(f * 33, f * 33 + 33))
        out = [i for i in range(100) if i not in val]
        s, states = np.zeros(4), []
        for i in [*out, *val]:
            s = 0.7 * s + 0.3 * np.tanh(w @ s + inputs * v[i, 0])
            states.append(s)
        states = np.array(states)
        x, y = states[10:67], v[out, 1:][10:]
        xc, yc = x - x.mean(0), y - y.mean(0)
        coef = np.linalg.solve(xc.T @ xc + 1e-8 * np.eye(4), xc.T @ yc)
        b = y.mean(0) - x.mean(0) @ coef
        want.append(((states[67:] @ coef + b - v[val, 1:]) ** 2).mean())
    assert got[2] == pytest.approx(np.mean(want), rel=1e-7)
    short = {r.grid_pos: r.score for r in readout.grid_search(rows.where("t < 14"), grid, units=4).collect()}
    assert short == dict.fromkeys(range(4), float("inf"))  # ten rows outside a fold: the warm-up takes them all
    best = readout.best_config(scores)
    assert best.first().grid_pos == min(got, key=lambda k: (got[k], k))
    tied = scores.withColumn("score", F.lit(1.0))
    assert readout.best_config(tied).first().grid_pos == 0
    with pytest.raises(Exception, match="no configuration"):
        readout.best_config(scores.withColumn("score", F.lit(float("inf")))).collect()
    assert readout.refit_best(rows, best.drop("score"), units=4).count() == 30


def test_search_of_a_long_series_in_bounded_memory(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("1L AS series_id", "id AS t", "pmod(xxhash64(id), 1000) / 2000 AS u").withColumn("y", F.col("u") * 0.5 + 0.1)
    search = readout.grid_search(rows, runs.grid(spark, spectral_radius=(0.5,), input_scaling=(0.3, 1.0), leak_rate=(1.0,)), units=2, folds=2)
    scores = {r.grid_pos: r.score for r in search.collect()}
    assert len(scores) == 2 and max(scores.values()) < 1e-4  # y follows from u alone
    u = np.array([r.u for r in rows.select("u").where("t < 3000").collect()])
    weights = readout._weights([{"spectral_radius": 0.5, "input_scaling": 1.0, "leak_rate": 1.0}], 2, 137)
    whole, pieces = readout._Readout(weights, 1e-6, 10), readout._Readout(weights, 1e-6, 10)
    learn = np.arange(3000) < 2000
    a = np.concatenate([p for _, p in whole.run(u, u / 2, learn)])
    b = np.concatenate([p for at in range(0, 3000, 7) for _, p in pieces.run(u[at : at + 7], u[at : at + 7] / 2, learn[at : at + 7])])
    assert a.shape == (1000, 1) and np.abs(a - b).max() < 1e-9


def test_pipeline_is_repeatable(table):
    first, again = benchmark.run_task(table, "stm"), benchmark.run_task(table.repartition(3), "stm")
    a, b = ({r.run_id: r.primary_metric_value for r in x.collect()} for x in (first, again))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) and 0 <= a[k] <= 6 for k in a)
    assert {r.task_name for r in benchmark.run_task(table, "parity", control="phase_random").collect()} == {"ablation:phase_random"}


def test_one_bad_series_does_not_stop_the_others(table):
    spoiled = table.withColumn("u01", F.when((F.col("series_id") == 1) & (F.col("t") == 40), 0.9).otherwise(F.col("u01")))
    spoiled = spoiled.withColumn("u", F.when((F.col("series_id") == 2) & (F.col("t") == 5), math.inf).otherwise(F.col("u")))
    runs_of = lambda df: {r.experiment_id: (r.success, r.failure_reason) for r in df.collect()}
    assert runs_of(benchmark.run_task(spoiled, "narma")) == {0: (True, None), 1: (False, "input outside [0, 0.5]"), 2: (True, None)}
    assert runs_of(benchmark.run_task(spoiled, "stm")) == {0: (True, None), 1: (True, None), 2: (False, "input is not finite")}
    assert runs_of(benchmark.run_task(spoiled, "parity")) == dict.fromkeys(range(3), (True, None))


def test_failures_are_runs_with_their_reason(table, monkeypatch):
    solve = readout.solve

    def planted(stats, alpha):
        if int(stats[0]) == 62:  # seven tenths of the series of 90 rows
            raise RuntimeError("planted")
        return solve(stats, alpha)

    rows = table.where("series_id > 0 OR t < 90").withColumn("u", F.when(F.col("series_id") == 1, 1e200 * (1 + F.col("u"))).when(F.col("series_id") == 3, 0.25).otherwise(F.col("u")))
    flat = table.where("series_id = 0").withColumns({"series_id": F.lit(3).cast("long"), "u": F.lit(0.25)})
    rows = rows.unionByName(flat)
    before = {r.experiment_id: r.primary_metric_value for r in benchmark.run_task(rows, "stm").collect()}
    monkeypatch.setattr(readout, "solve", planted)
    out = {r.experiment_id: r for r in benchmark.run_task(rows, "stm").collect()}
    assert out.keys() == {0, 1, 2, 3} and not out[0].success and out[0].failure_reason == "RuntimeError: planted"
    assert not out[1].success and "not finite" in out[1].failure_reason
    assert out[2].success and out[2].primary_metric_value == pytest.approx(before[2]) and out[3].success == (before[3] is not None)
    # streamed keys: an exception ends its key alone, also after it gave rows

    class Odd:
        def __init__(self, key):
            self.key, self.n = key[0], 0

        def feed(self, c):
            self.n += len(c["u"])
            if self.key == 1:
                raise ValueError("no odd keys")
            return {"v": c["u"] * 2}

        def end(self):
            if self.key == 2:
                raise KeyError("late")
            return None

    some = table.select("series_id", "t", "u").repartition(2, "series_id")
    good, bad = series.failed(series.over_keys(some, ("series_id",), ("t",), Odd, "v double", capture=True), ("series_id",))
    assert {r.series_id: r.reason for r in bad.collect()} == {1: "ValueError: no odd keys", 2: "KeyError: 'late'"}
    assert {r.series_id: r.n for r in good.groupBy("series_id").agg(F.count("v").alias("n")).collect()} == {0: 100}
    with pytest.raises(Exception, match="no odd keys"):
        series.over_keys(some, ("series_id",), ("t",), Odd, "v double").collect()


def test_leaky_failures(spark, table):
    rows = table.where("series_id = 0 OR series_id = 1 AND t < 12")
    grid = runs.grid(spark, spectral_radius=(0.5,), input_scaling=(1.0,), leak_rate=(0.5,))
    out = {r.experiment_id: (r.success, r.failure_reason) for r in benchmark.run_leaky(rows, grid=grid).collect()}
    assert out == {0: (True, None), 1: (False, "no configuration could be fitted")}


def test_ridge_of_wide_and_collinear_features(spark, monkeypatch):
    monkeypatch.setattr(readout, "HELD", 300_000)  # tasks put out several sums
    rng, f, n = np.random.default_rng(9), 512, 1500
    x = rng.normal(size=(n, f))
    x[:, 500:] = x[:, :12] + 1e-9 * rng.normal(size=(n, 12))  # nearly the same columns
    y = x[:, :5].sum(1, keepdims=True) + 2 * rng.normal(size=(n, 1))
    alphas = tuple(10.0**e for e in np.linspace(-6, 6, 50))
    table = spark.createDataFrame([(1, i, i * 5 // n, x[i].tolist(), y[i].tolist()) for i in range(n)], "series_id long, t long, fold int, x array<double>, y array<double>").repartition(7)
    fit = readout.ridge_cv(table.select("series_id", "fold", "x", "y"), alphas).first()

    def direct(rows, alpha):
        xc, yc = x[rows] - x[rows].mean(0), y[rows] - y[rows].mean(0)
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(f), xc.T @ yc)
        return w, y[rows].mean(0) - x[rows].mean(0) @ w

    fold, score = np.arange(n) * 5 // n, []
    for alpha in alphas:
        each = []
        for k in range(5):
            w, b = direct(fold != k, alpha)
            held = y[fold == k]
            each.append(1 - ((held - x[fold == k] @ w - b) ** 2).sum() / ((held - held.mean()) ** 2).sum())
        score.append(np.mean(each))
    best = alphas[int(np.argmax(score))]
    w, b = direct(np.ones(n, bool), best)
    assert fit.alpha == best and np.abs(np.array(fit.coef) - w[:, 0]).max() < 1e-8 and fit.intercept == pytest.approx(b[0], abs=1e-8)


def test_recurrence_over_many_batches(spark, table):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = by_series(series.narma_recurrence(table), "u", "y")
    states = by_series(features.leaky_features(table, units=3).select("series_id", "t", F.col("x")[2].alias("x")), "x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        again = by_series(series.narma_recurrence(table), "u", "y")
        assert all((whole[k] == again[k]).all() for k in whole)
        cut = by_series(features.leaky_features(table, units=3).select("series_id", "t", F.col("x")[2].alias("x")), "x")
        assert all((states[k] == cut[k]).all() for k in states)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
