"""The registered accuracy query against its SQL, on given and on odd events."""

from __future__ import annotations

from functools import partial

import duckdb
import pytest

from gatherline.operators import blocks
from gatherline.plans import series_queries

GIVEN = "/root/testdata/sf0.001"

# 640 rows that hold 323 right ones: 0.5046875, half-way between two values of six digits
TIED = ([1, 1, 1, 0, 0, 0] * 77 + [0] * 4 + [1, 0, 0, 0, 0] * 11 + [0] * 640)[:640]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events with nulls in each column, equal times, times that are all null, and a series of ``TIED``."""
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE e AS SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN date_trunc('month', ts) ELSE ts END END AS ts,
        CASE WHEN event_id % 29 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type,
        CASE WHEN event_id % 17 <> 0 THEN value END AS value, props FROM '{GIVEN}/events.parquet'""")
    con.executemany("INSERT INTO e VALUES (?, NULL, 9999, ?, 1.0, NULL)", [(10**6 + i, "error" if b else "view") for i, b in enumerate(TIED)])
    con.execute("INSERT INTO e SELECT 2000000 + i, NULL, 8888, NULL, NULL, NULL FROM range(9) r(i)")
    con.execute("INSERT INTO e SELECT CASE WHEN i < 5 THEN i END, TIMESTAMP '2024-01-01', 7777, CASE WHEN i = 5 THEN 'purchase' ELSE 'click' END, 1.0, NULL FROM range(6) r(i)")
    con.execute(f"COPY e TO '{at}/events.parquet'")
    return str(at)


def by_sql(at):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return dict(con.execute(series_queries.ORACLES["accuracy"]).fetchall())


def test_accuracy_matches_sql(spark):
    out = series_queries.QUERIES["accuracy"](spark, GIVEN)
    assert out.columns == ["series_id", "accuracy"]
    assert {r.series_id: r.accuracy for r in out.collect()} == by_sql(GIVEN)


def test_accuracy_of_odd_events(spark, odd):
    want = by_sql(odd)
    assert want[9999] == 0.504687 and want[8888] is None and None in want
    assert {r.series_id: r.accuracy for r in series_queries.QUERIES["accuracy"](spark, odd).collect()} == want


def test_accuracy_over_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(series_queries.blocks, "framed", partial(blocks.framed, block_rows=100))
    assert {r.series_id: r.accuracy for r in series_queries.QUERIES["accuracy"](spark, odd).collect()} == by_sql(odd)
