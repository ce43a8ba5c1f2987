"""Groups that span many tasks: the same results as windows of whole groups and NumPy give."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.operators import blocks, features, inference, runs, series

LARGE = 10**9


@pytest.fixture(scope="module")
def uneven(spark):
    """A series of 30,000 rows, one of a null key, and two thousand short ones."""
    long = spark.range(30_000).selectExpr("7L AS series_id", "id DIV 3 AS t", "id")
    short = spark.range(6_000).selectExpr("100 + id % 2000 AS series_id", "id AS t", "id")
    null = spark.range(500).selectExpr("CAST(null AS bigint) AS series_id", "id AS t", "id")
    rows = long.unionByName(short).unionByName(null)
    return rows.selectExpr("series_id", "t * 3 + id % 3 AS t", "pmod(xxhash64(id), 100000) / 100000 AS u", "CAST(id % 5 = 1 AS int) AS b", "'x' AS _size2", "id")


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def spread(df, group, block_rows, monkeypatch):
    """The most rows that one block of a group has, as ranged for ``block_rows``."""
    placed = blocks.ranged(df, group, ["t"], block_rows, df.count())
    return placed.groupBy(*group, "_block").count().agg(F.max("count")).first()[0]


def test_frames_over_blocks(uneven, monkeypatch):
    assert spread(uneven, ["series_id"], 1000, monkeypatch) < 4000
    for f in (
        lambda rows, n: series.lag_matrix(rows, 40, block_rows=n),
        lambda rows, n: series.rolling_parity(rows, 7, block_rows=n),
        lambda rows, n: series.chrono_split(rows, 0.7, block_rows=n),
        lambda rows, n: series.fold_ids(rows, 7, block_rows=n),
        lambda rows, n: series.fold_ids(rows, 7, balanced=False, block_rows=n),
    ):
        same(f(uneven, 1000), f(uneven, LARGE))
    # a mean's last digit depends on the frame's history, so these are compared to ten digits
    rounded = lambda rows: rows.withColumns({c: F.round(c, 10) for c in rows.columns if c in ("blend_u", "expected")})
    for f in (lambda rows, n: series.trailing_blend(rows, 25, ["u"], block_rows=n), lambda rows, n: series.recurrence_check(rows.withColumn("y", F.col("u") / 3), block_rows=n)):
        same(rounded(f(uneven, 1000)), rounded(f(uneven, LARGE)))
    # blocks that are shorter than the frame: the halo comes from several blocks
    few = uneven.where("series_id = 7 AND t < 300")
    same(series.lag_matrix(few, 120, block_rows=20), series.lag_matrix(few, 120, block_rows=LARGE))
    assert series.lag_matrix(few.limit(0), 3, block_rows=20).count() == 0


def test_halos_and_ranges_of_many_small_blocks(spark, monkeypatch):
    """What is broadcast and how many ranges there are follow neither a halo's depth nor a block's rows."""
    rows = spark.range(40_000).selectExpr("1L AS series_id", "id AS t", "CAST(id % 7 AS double) / 20 AS u")
    placed = blocks.placed_blocks(rows, ["series_id"], ["t"], 50, 40_000)
    assert placed.select("_block").distinct().count() >= 800 and blocks.ranged(rows, ["series_id"], ["t"], 50, 40_000).select(F.shiftright("_at", 33)).distinct().count() <= 16
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    around = blocks.halo(placed, ["series_id"], 120)
    assert sum(sent) <= 2 * placed.select("_block").distinct().count()
    sizes = around.groupBy("_block").agg(F.count("*").alias("n"), F.min("_place").alias("low"), F.max("_place").alias("high"))
    firsts = placed.groupBy("_block").agg(F.min("_place").alias("first")).where("first > 0")
    both = firsts.join(sizes, "_block")
    assert both.count() == firsts.count() and both.where("n <> least(first, 120) OR high <> first - 1 OR low <> first - n").isEmpty()


def test_running_totals_with_ties(spark, uneven):
    weighed = uneven.withColumn("t", F.floor(F.col("t") / 50)).withColumn("w", F.col("id") % 3)
    out = blocks.running(weighed, ["series_id"], ["t"], F.col("w"), block_rows=500).toPandas()
    for _, one in out[out.series_id == 7].groupby("series_id"):
        one = one.sort_values("_before", kind="stable")
        assert one._total.nunique() == 1 and one._total.iloc[0] == one.w.sum()
        assert one.groupby("t")._before.min().is_monotonic_increasing
        assert sorted(one._before + one.w)[-1] == one.w.sum() and (one._before >= 0).all()
    places = blocks.running(weighed, ["series_id"], ["t"], block_rows=500).where("series_id = 7").select("_before").toPandas()
    assert sorted(places._before) == list(range(30_000))


def test_quantiles_are_exact(uneven):
    shares = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    want = uneven.groupBy("series_id").agg(F.percentile("u", F.array(*map(F.lit, shares))).alias("q"))
    rounded = lambda rows: rows.select("series_id", F.transform("q", lambda x: F.round(x, 12)).alias("q"))
    holes = uneven.withColumn("u", F.when(F.col("id") % 11 > 0, F.col("u")))
    same(rounded(blocks.quantiles(uneven, ["series_id"], "u", shares, block_rows=700)), rounded(want))
    same(rounded(blocks.quantiles(holes, ["series_id"], "u", shares)), rounded(holes.groupBy("series_id").agg(F.percentile("u", F.array(*map(F.lit, shares))).alias("q"))))


def test_signed_ranks_over_blocks(uneven):
    pairs = uneven.select(F.col("series_id").alias("grp"), F.col("id").alias("pair_id"), F.round(F.col("u") * 2000).alias("a"), F.lit(900.0).alias("b"))
    rounded = lambda n: inference.wilcoxon(pairs, block_rows=n).select("grp", "n", "ties", "statistic", F.round("z", 9).alias("z"), F.round("p", 9).alias("p"))
    same(rounded(100), rounded(LARGE))
    big = rounded(100).where("grp = 7").first()
    d = np.array([r.a - r.b for r in pairs.where("grp = 7").collect()])
    d = d[d != 0]
    value, where, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[where]
    assert (big.n, big.statistic, big.ties) == (len(d), min(rank[d > 0].sum(), rank[d < 0].sum()), (counts**3 - counts).sum())


def test_ties_are_counted_exactly(spark):
    """A sum of cubes beyond 2**53; one beyond 2**63 stops neither z nor p."""
    pairs = spark.range(400_003).selectExpr("'g' AS grp", "CAST(id % 2 AS double) - 3 AS a", "0D AS b")
    assert inference.wilcoxon(pairs).first().ties == 200_002**3 - 200_002 + 200_001**3 - 200_001
    huge = spark.range(2_100_000).selectExpr("'g' AS grp", "1D AS a", "0D AS b")
    assert inference.wilcoxon(huge).select("n", "statistic", "z", "p").first() == (2_100_000, 0.0, pytest.approx(-np.sqrt(2_100_000)), 0.0)


@pytest.mark.parametrize("by_broadcast", [True, False])
def test_bootstrap_draws(spark, monkeypatch, by_broadcast):
    monkeypatch.setattr(inference, "BROADCAST_VALUES", 10**6 if by_broadcast else 0)
    monkeypatch.setattr(inference, "CHUNK", 16)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=1), "b": rng.normal(size=7), "c": rng.normal(size=1003), None: rng.normal(size=5)}
    rows = [(g, len(x) - i, float(v)) for g, x in groups.items() for i, v in enumerate(x)]
    got = {(r.grp, r.b): r["mean"] for r in inference.boot_means(spark.createDataFrame(rows, "grp string, pair_id long, x double"), resamples=30, block_rows=100).collect()}
    assert set(got) == {(g, b) for g in groups for b in range(1, 31)}
    for (g, b), mean in got.items():
        x, n = groups[g][::-1], len(groups[g])
        at = [int(hashlib.md5(":".join(["42", *([g] if g else []), str(b), str(i // 4)]).encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8], 16) % n for i in range(n)]
        assert mean == pytest.approx(x[at].mean(), abs=1e-12)


def test_draws_are_never_broadcast(spark, monkeypatch):
    """Groups beyond HELD by an exchange, though the draws open from a small table; others packed, their resamples in parts."""
    for name, limit in (("BROADCAST_VALUES", 0), ("HELD", 500), ("PACK", 16), ("UNIT", 600), ("CHUNK", 16)):
        monkeypatch.setattr(inference, name, limit)
    rng = np.random.default_rng(3)
    groups = {(1, "a"): rng.normal(size=3), (1, None): rng.normal(size=203), (None, "c"): rng.normal(size=1003), (2, "c"): rng.normal(size=500)}
    rows = [(*g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)]
    out = inference.boot_means(spark.createDataFrame(rows, "e int, s string, place long, x double"), ["e", "s"], order="place", resamples=7)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.e, r.s, r.b): r["mean"] for r in out.collect()}
    assert set(got) == {(*g, b) for g in groups for b in range(1, 8)}
    for (e, s, b), mean in got.items():
        x, n = groups[e, s], len(groups[e, s])
        head = ":".join(["42", *(str(k) for k in (e, s) if k is not None), str(b)])
        digests = b"".join(hashlib.md5(f"{head}:{q}".encode()).digest() for q in range(-(-n // 4)))
        assert mean == pytest.approx(x[np.frombuffer(digests, ">u4")[:n] % n].mean(), abs=1e-12)


def test_bootstrap_of_a_million_values(spark, monkeypatch):
    monkeypatch.setattr(inference, "BROADCAST_VALUES", 0)
    n = 1_000_000
    values = spark.range(n).selectExpr("'g' AS grp", "id AS pair_id", "CAST(pmod(id * 7919, 1000) AS double) AS x")
    got = {r.b: r["mean"] for r in inference.boot_means(values, resamples=2, block_rows=100_000).collect()}
    x = (np.arange(n) * 7919 % 1000).astype(float)
    for b in (1, 2):
        digests = b"".join(hashlib.md5(f"42:g:{b}:{q}".encode()).digest() for q in range(n // 4))
        assert got[b] == pytest.approx(x[np.frombuffer(digests, ">u4") % n].mean(), rel=1e-12)


def test_long_logs_pair_by_place(spark, monkeypatch):
    rows = spark.range(900).selectExpr("'e' AS experiment_id", "if(id % 3 = 0, 'esn', 'stm') AS task_name", "true AS success", "CAST(pmod(id * 7, 900) AS string) AS timestamp_utc", "CAST(id AS string) AS run_id", "'mc' AS primary_metric_name", "CAST(id AS double) AS primary_metric_value")
    want = sorted(map(str, runs.pair_by_position(rows, "stm", "esn", "mc").collect()))
    monkeypatch.setattr(runs, "running", lambda *a: blocks.running(*a, block_rows=50))
    assert sorted(map(str, runs.pair_by_position(rows, "stm", "esn", "mc").collect())) == want and len(want) == 300


def test_recurrences_in_blocks(spark, uneven):
    rows = uneven.withColumn("u01", F.col("u") / 2)
    for f in (lambda n: series.narma_recurrence(rows, block_rows=n), lambda n: features.leaky_features(rows, units=3, block_rows=n)):
        want, got = f(LARGE), f(4000)
        assert got.columns == want.columns
        column = got.columns[-1]
        both = got.withColumnRenamed(column, "a").select("series_id", "t", "a").join(want.withColumnRenamed(column, "b").select(F.col("series_id").alias("s"), F.col("t").alias("q"), "b"), F.col("series_id").eqNullSafe(F.col("s")) & (F.col("t") == F.col("q")))
        numbers = [(np.atleast_1d(r.a), np.atleast_1d(r.b)) for r in both.select("a", "b").collect()]
        assert len(numbers) == want.count() == got.count() and max(np.abs(a - b).max() for a, b in numbers) < 1e-12


def test_blocks_that_began_wrong_run_again(spark):
    class Total:  # never forgets where it began
        def __init__(self, key, state=None):
            self.sum = state[0] if state else 0.0

        def feed(self, u):
            out = self.sum + np.cumsum(u)
            self.sum = float(out[-1])
            return out

        def state(self):
            return [self.sum]

    rows = spark.range(6_000).selectExpr("1L AS series_id", "id AS t", "CAST(id % 7 AS double) AS u")
    placed = blocks.placed_blocks(rows, ["series_id"], ["t"], 1000, 6_000)
    values, again = series.in_blocks(placed, ("series_id",), Total, "double", lead=20)
    got = np.array([r.value for r in values.orderBy("_place").collect()])
    n = placed.select("_block").distinct().count()
    assert (got == np.cumsum(np.arange(6_000) % 7)).all() and again >= n - 1  # one after the other
    settled = series.in_blocks(blocks.placed_blocks(rows.withColumn("u", F.col("u") / 20), ["series_id"], ["t"], 1000, 6_000), ("series_id",), series.Recurrence, "double")
    assert settled[1] == 0 and settled[0].count() == 6_000
