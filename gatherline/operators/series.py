"""Operators over many series at once: lags, rolling parity, blends, recurrences, splits and folds.

A series table has ``series_id, t`` and value columns. Frames are by series and ordered by ``t``; series of up to
``block_rows`` rows are windows of one task, and operators that follow one another share an exchange and sort. A longer
series is cut into blocks of that size (see ``blocks``), with the same results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gatherline.operators.blocks import BLOCK_ROWS, exceeds, framed, halo, placed_blocks, running
from gatherline.sources.scratch import written

SERIES = ("series_id",)


def lag_matrix(series: DataFrame, delay_max: int, value: str = "u", group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``y_k[t] = u[t - k]`` for k up to ``delay_max``; 0.0 before the series begins."""
    lags = lambda w: {f"y_{k}": F.lag(value, k, 0.0).over(w) if k else F.col(value) for k in range(delay_max + 1)}
    return framed(series, group, ["t"], delay_max, lags, block_rows)


def rolling_parity(series: DataFrame, width: int, value: str = "b", group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``y``: exclusive or of the last ``width`` bits; 0 for the first ``width - 1`` rows."""

    def parity(w: Window) -> dict:
        frame = w.rowsBetween(1 - width, 0)
        return {"y": F.when(F.count("*").over(frame) < width, 0).otherwise(F.bit_xor(value).over(frame)).cast("int")}

    return framed(series, group, ["t"], width - 1, parity, block_rows)


def trailing_blend(features: DataFrame, depth: int, columns: list[str], group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``blend_x = 0.5 x + 0.5 mean(x over this and the ``depth`` rows before)`` for each column; ``depth`` >= 1."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    blend = lambda w: {f"blend_{c}": 0.5 * F.col(c) + 0.5 * F.avg(c).over(w.rowsBetween(-depth, 0)) for c in columns}
    return framed(features, group, ["t"], depth, blend, block_rows)


def in_order(rows: DataFrame, group, step, schema: str) -> DataFrame:
    """``step(key)`` makes a function from arrays of a series' next rows to those of its results; runs over sorted rows.

    Rows are sorted by group and ``t`` in their partition and come in Arrow batches, so a series may have any length.
    ``rows``: the group's columns, ``t`` and one value; ``schema`` adds result columns to those.
    """
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, go = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True))
            values, parts, at = batch.column(n + 1).to_numpy(zero_copy_only=False), [], 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if go is None or keys[at] != key:
                    key, go = keys[at], step(keys[at])
                parts.append(go(values[at:to]))
                at = to
            results = pa.concat_arrays(parts) if parts else pa.array([], batch.schema.field(n + 1).type)
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, results], names=[*batch.schema.names, "result"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.repartition(*group).sortWithinPartitions(*group, "t").mapInArrow(run, f"{kinds}, {schema}")


def over_keys(rows: DataFrame, keys, order, make, schema: str, capture: bool = False) -> DataFrame:
    """``make(key)`` gives an object for each key, which is fed the key's rows in order, a batch at a time, and ended.

    ``feed(columns)`` and ``end()`` return rows of the result as a dict of columns, or nothing. ``rows``: the key's columns,
    those of ``order``, and numbers that ``feed`` gets as NumPy arrays by name. A key's rows stream through one task,
    sorted there, so it may have any number of them.

    With ``capture`` an exception ends its key alone: a further column ``failure_reason`` is null but in one row, which
    has nulls for results. Rows that the key gave before stay; ``failed`` tells them apart.
    """
    n = len(keys)
    names = [c.split()[0] for c in schema.split(", ")]
    schema = f"{schema}, failure_reason string" if capture else schema
    typed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    made = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, kinds = None, None, []

        def result(call, *what) -> Iterator[pa.RecordBatch]:
            nonlocal one
            try:
                columns = call(*what)
                if columns and capture:
                    columns["failure_reason"] = pa.nulls(len(next(iter(columns.values()))), pa.string())
            except Exception as error:
                if not capture:
                    raise
                one, columns = None, {c: [None] for c in names} | {"failure_reason": [f"{type(error).__name__}: {error}"]}
            if columns:
                length = len(next(iter(columns.values())))
                own = [pa.array([k] * length, kind) for k, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *(c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns.values(), made, strict=False))], names=[*keys, *columns])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n)]
            found = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True))
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names[n:]}
            at = 0
            while at < len(found):
                to = at + 1
                while to < len(found) and found[to] == found[at]:
                    to += 1
                if found[at] != key:
                    if one is not None:
                        yield from result(one.end)
                    key, one = found[at], make(found[at])
                if one is not None:  # else the key has failed
                    yield from result(one.feed, {c: v[at:to] for c, v in values.items()})
                at = to
        if one is not None:
            yield from result(one.end)

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, f"{typed}, {schema}")


def failed(results: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """What ``over_keys`` gave, written once and split: the rows of the keys that went through, and ``*keys, reason``."""
    results = written(results)
    reasons = results.where("failure_reason IS NOT NULL").select(*keys, F.col("failure_reason").alias("reason"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    bad = reasons.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return results.join(bad, reduce(lambda a, b: a & b, same), "left_anti").drop("failure_reason"), reasons


class Recurrence:
    """The tenth-order recurrence; its state is the last ten values and the last nine inputs."""

    width = 19

    def __init__(self, key, state: list[float] | None = None):
        self.key = key
        y, u = (state[:10], state[10:]) if state else ([0.0] * 10, [])
        self.u, self.y, self.seen = deque(u, maxlen=10), deque(y, maxlen=10), 10 if state else 0

    def feed(self, inputs: np.ndarray) -> pa.Array:
        if not ((inputs >= 0) & (inputs <= 0.5)).all():
            raise ValueError(f"the recurrence's input must lie in [0, 0.5], series {self.key}")
        out, u, y = [], self.u, self.y
        for x in inputs.tolist():
            u.append(x)
            # the first value that the recurrence gives follows its eleventh input
            new = 0.3 * y[-1] + 0.05 * y[-1] * sum(y) + 1.5 * u[0] * x + 0.1 if self.seen >= 10 else 0.0
            self.seen += 1
            y.append(new)
            out.append(new)
        return pa.array(out, pa.float64())

    def state(self) -> list[float]:
        return [*self.y, *([0.0] * 9 + list(self.u))[-9:]]


class _Block:
    """A block of a series: from the state it is given, or from none over the rows of its halo; puts out where it began and ended."""

    def __init__(self, system, key):
        self.system, self.key, self.run, self.began = system, key, None, None

    def feed(self, c: dict) -> dict | None:
        if self.run is None:
            given = c["start"][0]
            self.run = self.system(self.key, list(given) if given is not None else None)
        lead = int(c["lead"].sum())  # a halo's rows come first
        if lead:
            self.run.feed(c["u"][:lead])
        if lead == len(c["u"]):
            return None
        if self.began is None:
            self.began = self.run.state()
        values, n = self.run.feed(c["u"][lead:]), len(c["u"]) - lead
        return {"place": c["place"][lead:], "value": values, "began": pa.nulls(n, pa.list_(pa.float64())), "ended": pa.nulls(n, pa.list_(pa.float64()))}

    def end(self) -> dict:
        return {"place": [None], "value": [None], "began": [self.began], "ended": [self.run.state()]}


#: Rows before a block over which its first guess washes out, and what two blocks' states may differ by.
LEAD, AGREE = 2_000, 1e-14


def in_blocks(placed: DataFrame, group, system, kind: str, lead: int = LEAD) -> tuple[DataFrame, int]:
    """The values of ``system`` over ``placed`` blocks with input ``u``: ``*group, _place, value``, and how often a block ran again.

    All blocks run at once, each from a cold start ``lead`` rows before its first. Where that differs from the state in which
    the block before ended, by more than AGREE of it, the block runs again from there, and so on until all agree: at worst one
    after the other, which is the sequential result. Rows are written once a run; what is compared is one row a block.
    """
    keys = (*group, "_block")
    some = placed.select(*keys, "_at", "_place", "u")
    schema = f"place bigint, value {kind}, began array<double>, ended array<double>"
    made = lambda key: _Block(system, key)

    def ran(rows: DataFrame) -> DataFrame:
        rows = rows.select(*keys, "_at", F.col("_place").alias("place"), "u", "lead", "start")
        return written(over_keys(rows.repartition(*keys), keys, ("_at",), made, schema))

    cold = F.lit(None).cast("array<double>")
    results = [ran(some.withColumns({"lead": F.lit(False), "start": cold}).unionByName(halo(placed, group, lead).select(*some.columns).withColumns({"lead": F.lit(True), "start": cold})))]
    before, again = F.lag("ended").over(Window.partitionBy(*group).orderBy("_block")), 0
    states = results[0].where("ended IS NOT NULL").select(*keys, "began", "ended")
    while True:
        gap = F.array_max(F.zip_with("began", "start", lambda a, b: F.abs(a - b) / (1 + F.abs(b))))
        off = written(states.withColumn("start", before).where(F.col("start").isNotNull() & ~F.coalesce(gap <= AGREE, F.lit(False))).select(*keys, "start"))
        n = off.count()
        if not n:
            break
        again += n
        named = off.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)], "start")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_n{i}")) for i, k in enumerate(keys)])
        new = ran(some.join(F.broadcast(named), same).withColumn("lead", F.lit(False)))
        results = [r.join(F.broadcast(named.drop("start")), same, "left_anti") for r in results] + [new]
        states = written(states.join(F.broadcast(named.drop("start")), same, "left_anti").unionByName(new.where("ended IS NOT NULL").select(*keys, "began", "ended")))
    out = reduce(DataFrame.unionByName, results)
    return out.where("place IS NOT NULL").select(*group, F.col("place").alias("_place"), "value"), again


def _sequential(system):
    def step(key):
        run = system(key)
        return run.feed

    return step


def evolved(rows: DataFrame, group, system, kind: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(*group, t, u)`` with the values of a system that goes on from row to row; long series in blocks."""
    every = exceeds(rows, group, block_rows)
    if not every:
        return in_order(rows, group, _sequential(system), f"{name} {kind}")
    placed = placed_blocks(rows.withColumnRenamed(rows.columns[-1], "u"), group, ["t"], block_rows, every)
    values, _ = in_blocks(placed, group, system, kind)
    values = values.select(*[F.col(g).alias(f"_v{i}") for i, g in enumerate(group)], F.col("_place").alias("_vp"), F.col("value").alias(name))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_v{i}")) for i, g in enumerate(group)], F.col("_place") == F.col("_vp"))
    return placed.join(values, same).select(*group, "t", F.col("u").alias(rows.columns[-1]), name)


def narma_recurrence(series: DataFrame, value: str = "u01", group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series_id, t, u, y``: the tenth-order recurrence driven by ``value``, which must lie in [0, 0.5].

    ``y`` at t is the recurrence's value after that input. Parallel over series, and over the blocks of longer ones (``in_blocks``).
    """
    rows = series.select(*group, F.col("t").cast("bigint").alias("t"), F.col(value).cast("double").alias("u"))
    return evolved(rows, group, Recurrence, "double", "y", block_rows)


def recurrence_check(stored: DataFrame, group=SERIES, rtol: float = 1e-10, atol: float = 1e-12, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``expected`` and ``bad``: does the stored ``y`` follow the recurrence from its own past? Frames only."""

    def follows(w: Window) -> dict:
        ten = w.rowsBetween(-10, -1)
        past, first = F.lag("y", 1).over(w), F.count("*").over(ten) < 10
        return {"expected": F.when(first, F.lit(0.0)).otherwise(0.3 * past + 0.05 * past * F.sum("y").over(ten) + 1.5 * F.lag("u", 9).over(w) * F.col("u") + 0.1)}

    out = framed(stored, group, ["t"], 10, follows, block_rows)
    return out.withColumn("bad", F.abs(F.col("y") - F.col("expected")) > atol + rtol * F.abs(F.col("expected")))


def chrono_split(series: DataFrame, train_frac: float, group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``is_train``: the first ``int(n * train_frac)`` rows of each series."""
    placed = running(series, group, ["t"], block_rows=block_rows)
    return placed.withColumn("is_train", F.col("_before") < F.floor(F.col("_total") * F.lit(train_frac))).drop("_before", "_total")


def fold_ids(series: DataFrame, folds: int, balanced: bool = True, group=SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fold``: contiguous blocks in order of t.

    Balanced: the first ``n mod folds`` blocks hold one row more. Otherwise blocks have ``n // folds`` rows and the
    rest has no fold (null). With fewer rows than folds, rows are folds of their own (balanced), or null.
    """
    at, n = F.col("_before"), F.col("_total")
    size, more = F.floor(n / folds), n % folds
    if balanced:
        cut = more * (size + 1)
        fold = F.when(at < cut, F.floor(at / (size + 1))).otherwise(more + F.floor(F.try_divide(at - cut, size)))
    else:
        fold = F.floor(F.try_divide(at, size))
        fold = F.when(fold < folds, fold)
    return running(series, group, ["t"], block_rows=block_rows).withColumn("fold", fold.cast("int")).drop("_before", "_total")
