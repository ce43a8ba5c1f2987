"""Data-quality checks on tables: finiteness, ranges, drift, coverage, equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.functions.scoring import is_finite
from gatherline.operators.runs import succeeded


def finite_report(rows: DataFrame, columns: list[str], group=("experiment_id",)) -> DataFrame:
    """``*group, name, bad``: cells of each column that are null, NaN or infinite."""
    counts = rows.groupBy(*group).agg(*[F.count_if(~F.coalesce(is_finite(F.col(c)), F.lit(False))).alias(c) for c in columns])
    return counts.unpivot(list(group), columns, "name", "bad")


def first_violation(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that doesn't hold, or null; an unknown outcome breaks the rule."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def range_violations(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return rows.withColumn("rule", first_violation(rules)).where("rule IS NOT NULL")


def _hashable(name: str, kind: T.DataType) -> list[Column]:
    """What stands for a column in a row's hash: its value, with a map as sorted entries, and where it has nulls."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        c = F.array_sort(F.map_entries(c))
    inside = [F.transform(c, lambda x: x.isNull())] if isinstance(kind, T.ArrayType) else []
    return [c.isNull(), c, *inside]


def multiset_digest(rows: DataFrame, group=()) -> DataFrame:
    """``*group, n, sum_1, sum_2``: the same for two tables that hold the same rows as often, in whatever order.

    Two 64-bit hashes of each row are summed where the rows are read, so no row is moved. Rows are told apart as in a
    grouping: nulls are equal, so are NaNs, and 0.0 and -0.0. Different tables agree by a chance of about 2**-128.
    Columns count in their order; of nested values only an array's own nulls are told from missing ones.
    """
    parts = [x for f in rows.schema.fields for x in _hashable(f.name, f.dataType)]
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(h("a"), F.lit(0)).alias("sum_1"), F.coalesce(h("b"), F.lit(0)).alias("sum_2"))


def compared_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rows, other_rows, same`` of two tables with the same columns, by their digests."""
    one = multiset_digest(a).select(F.col("n").alias("rows"), "sum_1", "sum_2")
    other = multiset_digest(b).select(F.col("n").alias("other_rows"), F.col("sum_1").alias("o1"), F.col("sum_2").alias("o2"))
    return one.join(other).select("rows", "other_rows", ((F.col("rows") == F.col("other_rows")) & (F.col("sum_1") == F.col("o1")) & (F.col("sum_2") == F.col("o2"))).alias("same"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do both hold the same rows, as often? Columns of other names or types are not the same."""
    alike = [(f.name, f.dataType.simpleString()) for f in a.schema] == [(f.name, f.dataType.simpleString()) for f in b.schema]
    return alike and compared_tables(a, b).first()["same"]


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one of two tables has and the other hasn't, or not as often, with ``side`` a or b; none without a
    comparison of rows if the digests agree."""
    if same_rows(a, b):
        return a.limit(0).withColumn("side", F.lit("a"))
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def table_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-6, keys=("series_id", "t", "j"), value: str = "x", group=("series_id",)) -> DataFrame:
    """``*group, max_diff, beyond, unmatched``: entries further apart than ``tolerance``, and without a partner."""
    both = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r")), list(keys), "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy(*group).agg(F.max(gap).alias("max_diff"), F.count_if(gap > tolerance).alias("beyond"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched"))


def config_drift(runs: DataFrame) -> DataFrame:
    """Configuration paths that were logged with several fingerprints."""
    return runs.groupBy("config_path").agg(F.count_distinct("config_hash").alias("hashes")).where("hashes > 1")


def fingerprint_consistency(runs: DataFrame, keys=("circuit_hash", "task_seed", "task_name"), tolerance: float = 1e-9) -> DataFrame:
    """Runs of equal fingerprint and seed whose metrics differ."""
    v = F.col("primary_metric_value").try_cast("double")
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(v) - F.min(v)).alias("spread")).where(F.col("spread") > tolerance)


def cell_coverage(runs: DataFrame, cell=("experiment_id", "task_name"), seeds: int = 5, realisations: int = 3) -> DataFrame:
    out = runs.where(succeeded()).groupBy(*cell).agg(F.count_distinct("task_seed").alias("seeds"), F.count_distinct("reservoir_seed").alias("realisations"))
    return out.withColumn("covered", (F.col("seeds") >= seeds) & (F.col("realisations") >= realisations))


def rolled_up(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_name, status`` and the overall status of checks: each frame lists violations, none of them passes."""
    rows = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status")) for name, frame in checks.items()]
    each = reduce(DataFrame.unionByName, rows)
    return each.unionByName(each.agg(F.every(F.col("status") == "PASS").alias("ok")).select(F.lit("overall").alias("check_name"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status")))


def all_pass(statuses: str) -> Column:
    """PASS if every value of a status map is."""
    return F.when(F.forall(F.map_values(statuses), lambda s: s == "PASS"), "PASS").otherwise("FAIL")
