"""Run logs and series as streams: running totals, live verdicts, live recurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gatherline.operators import gates
from gatherline.operators.runs import KWH_PER_SECOND


def totals(runs: DataFrame, seconds: str = "runtime_seconds", late: str = "1 day", key: str = "experiment_id") -> DataFrame:
    """Runs, seconds, energy and last update of each experiment; a run that arrives again within ``late`` counts once."""
    once = runs.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp")).withWatermark("timestamp_utc", late).dropDuplicatesWithinWatermark(["run_id"])
    s = F.sum(F.coalesce(F.col(seconds), F.lit(0.0)))
    return once.groupBy(key).agg(F.count("*").alias("total_runs"), s.alias("total_seconds"), (s * KWH_PER_SECOND).alias("kwh"), F.max("timestamp_utc").alias("last_update"))


def verdicts(runs: DataFrame) -> DataFrame:
    """``experiment_id, gate, verdict`` of the moment gates, from moments kept as state."""
    rows = {"G1": gates.g1(), "G2": gates.g2(), "G2.5": gates.g25(), "G4": gates.g4()}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("verdict")) for k, v in rows.items()])).alias("g")
    return gates.moments(runs).select("experiment_id", each).select("experiment_id", "g.gate", "g.verdict")


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream over what there is, checkpointed under ``folder``; each trigger's complete result replaces the last."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")

    query: StreamingQuery = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def run_appended(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream over what there is, checkpointed under ``folder``, and read back all that it appended."""
    query: StreamingQuery = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


class SeriesSoFar:
    """What a series' next rows need of the rows before: the last ten y, and the last u of recurrence and blend."""

    def __init__(self, depth: int, t: int = 0, y: list[float] | None = None, u: list[float] | None = None):
        self.depth, self.t, self.y, self.u = depth, t, y or [0.0], u or []

    def add(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The recurrence's y and the trailing blend at each of the next rows."""
        every = np.concatenate([self.u, u])
        past, ys = self.y, []
        for i in range(len(self.u), len(every)):
            new = 0.3 * past[-1] + 0.05 * past[-1] * sum(past[-10:]) + 1.5 * float(every[i - 9]) * float(every[i]) + 0.1 if self.t + len(ys) >= 10 else 0.0
            past = [*past[-9:], new]
            ys.append(new)
        at = np.arange(len(self.u), len(every))
        total = np.concatenate([[0.0], np.cumsum(every)])
        first = np.maximum(at - self.depth, 0)
        blend = 0.5 * u + 0.5 * (total[at + 1] - total[first]) / (at + 1 - first)
        self.t, self.y, self.u = self.t + len(u), past, every[-max(9, self.depth) :].tolist()
        return np.array(ys), blend


class LiveSeries(StatefulProcessor):
    """Holds a series' rows until the watermark has passed them, then lets them go on in order of time and id."""

    def __init__(self, depth: int = 3):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "t long, y array<double>, u array<double>")
        self.waiting = handle.getListState("waiting", "at long, id long, u double")

    def _wait(self, rows: list[tuple[int, int, float]]) -> None:
        # a row may go on once no earlier one is let in, which is after the millisecond that it is in
        self.handle.registerTimer(min(at for at, *_ in rows) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            some = list(zip(part["at"].tolist(), part["id"].tolist(), part["u"].tolist(), strict=True))
            if some:
                self.waiting.appendList(some)
                self._wait(some)
        yield pd.DataFrame({"series_id": [], "t": [], "id": [], "y": [], "blend": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] < limit], [r for r in held if r[0] >= limit]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self._wait(later)
            so_far = SeriesSoFar(self.depth, *(self.done.get() if self.done.exists() else ()))
            t = np.arange(so_far.t, so_far.t + len(ready))
            y, blend = so_far.add(np.array([r[2] for r in ready]))
            self.done.update((int(so_far.t), [float(v) for v in so_far.y], [float(v) for v in so_far.u]))
            yield pd.DataFrame({"series_id": key[0], "t": t, "id": [r[1] for r in ready], "y": y, "blend": blend})

    def close(self) -> None:
        pass


def live_series(series: DataFrame, depth: int = 3, late: str = "1 hour") -> DataFrame:
    """``series_id, t, id, y, blend`` of a stream ``(series_id, ts TIMESTAMP, id, u)``: the recurrence of u and its trailing blend.

    Rows may arrive out of order by up to ``late``: they wait in the state until the watermark has passed them, so what
    comes out, ``t`` counted from 0 by time and id, is what the whole series in order gives. Later rows are dropped. The
    state holds the rows of the last ``late`` and a few numbers for each series. Needs the RocksDB state store.
    """
    rows = series.select("series_id", "ts", "id", "u", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("series_id").transformWithStateInPandas(LiveSeries(depth), "series_id bigint, t bigint, id bigint, y double, blend double", "Append", "EventTime")
