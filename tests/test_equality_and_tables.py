"""Digests that tell tables apart, the headline table against plain loops, and matched feature counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.operators import charts, features, quality

SCHEMA = "k int, x double, s string, a array<double>, m map<string,int>"
NAN = float("nan")


def test_digest_is_of_the_multiset(spark):
    rows = [(1, 0.5, "a", [1.0, None], {"p": 1, "q": 2}), (1, 0.5, "a", [1.0, None], {"p": 1, "q": 2}), (2, NAN, None, None, None), (None, -0.0, "", [], {}), (3, 1e300, "é", [NAN], {"q": None})]
    table = spark.createDataFrame(rows, SCHEMA)
    again = spark.createDataFrame([(3, 1e300, "é", [NAN], {"q": None}), (None, 0.0, "", [], {}), rows[0], (2, NAN, None, None, None), (1, 0.5, "a", [1.0, None], {"q": 2, "p": 1})], SCHEMA)
    assert quality.same_rows(table, again.repartition(3))
    others = [
        rows[:-1], [*rows, rows[0]], [*rows[:1], *rows[2:], rows[2]], [(1, 0.5, "a", [None, 1.0], {"p": 1, "q": 2}), *rows[1:]], [(1, 0.5, "a", [1.0], {"p": 1, "q": 2}), *rows[1:]],
        [(1, 0.5, "a", [1.0, None], {"p": 2, "q": 1}), *rows[1:]], [*rows[:3], (None, -0.0, None, [], {}), rows[4]], [*rows[:3], (0, -0.0, "", [], {}), rows[4]], [],
    ]
    for other in others:
        assert not quality.same_rows(table, spark.createDataFrame(other, SCHEMA)), other
    assert quality.same_rows(table.limit(0), spark.createDataFrame([], SCHEMA))
    assert not quality.same_rows(table.select("k"), table.select(F.col("k").cast("long"))) and not quality.same_rows(table.select("k", "s"), table.select("s", "k"))
    swapped = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert not quality.same_rows(*swapped)
    per = quality.multiset_digest(table, ["k"]).collect()
    assert {r.k: r.n for r in per} == {1: 2, 2: 1, 3: 1, None: 1}


def test_differences_are_two_sided(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, s string")
    assert sorted(tuple(r) for r in quality.differences(a, b).collect()) == [(1, "x", "a"), (3, "z", "b")]
    assert quality.differences(a, a.orderBy("s")).isEmpty()


def test_headline(spark):
    rng = np.random.default_rng(6)
    values = {(e, s): rng.normal(1 + (s == "stm"), 0.3, n) for e in ("e1", "e2") for s, n in (("stm", 12), ("esn", 10), ("ablation:x", 2))}
    rows = [(e, s, "true", f"2026-01-{i + 1:02d}", f"{i}", "mc", float(v)) for (e, s), x in values.items() for i, v in enumerate(x)]
    rows += [("e1", "stm", "false", "2026-01-01", "f", "mc", 99.0), ("e1", "stm", "true", "2026-01-01", "g", "accuracy", 99.0)]
    log = spark.createDataFrame(rows, "experiment_id string, task_name string, success string, timestamp_utc string, run_id string, primary_metric_name string, primary_metric_value double")
    out = {(r.experiment_id, r.system): r for r in charts.headline(log, "mc", "esn", resamples=300).collect()}
    assert out.keys() == values.keys()
    for (e, s), r in out.items():
        x = values[e, s]
        assert r.n == len(x) and r["mean"] == pytest.approx(x.mean()) and r.low <= r["mean"] <= r.high and r.high - r.low < 5 * x.std() / len(x) ** 0.5
        if s == "esn":
            assert r.paired_delta is None and r.holm_p is None
        else:
            n = min(len(x), 10)
            assert r.paired_delta == pytest.approx((x[:n] - values[e, "esn"][:n]).mean()) and (r.holm_p is None) == (n < 3)
    assert all(out[e, "stm"].holm_p < 0.01 for e in ("e1", "e2"))
    compute = {(r.experiment_id, r.task_name): r for r in charts.compute_table(log, F.lit(2.0)).collect()}
    assert compute["e2", "esn"].cell_seconds == 20.0 and compute["e2", "esn"].group_seconds == 48.0 and compute["e2", "esn"].group_kwh == pytest.approx(48 * 15 / 3.6e6)


def test_matched_feature_counts(spark):
    table = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([0.0] * 4,)], "x array<double>")
    assert features.matched_count(table) == 4 and features.matched_count(table, pairs=True) == 4 + 6
    for bad in (table.limit(0), table.unionByName(spark.createDataFrame([([1.0],)], "x array<double>"))):
        with pytest.raises(ValueError, match="one size"):
            features.matched_count(bad)
