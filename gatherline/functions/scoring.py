"""Score aggregates and guards as column expressions, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def require_finite(x: Column, name: str) -> Column:
    """``x``, or an error that names it where it is NaN or infinite; nulls pass."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"non-finite value in {name}"))).otherwise(x)


def binarised(x: Column, at: float = 0.5) -> Column:
    return (x >= at).cast("int")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r, and 0 where a side is constant (plain ``corr`` would divide by zero)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread)), F.lit(0.0))


def r_squared(a: Column, b: Column, guarded: bool = True) -> Column:
    """The squared correlation; a NaN or infinity raises unless ``guarded`` is off."""
    r = correlation(*_finite(guarded, a, b))
    return r * r


def _finite(guarded: bool, *columns: Column) -> tuple[Column, ...]:
    return tuple(require_finite(c, name) for c, name in zip(columns, ("prediction", "truth"), strict=True)) if guarded else columns


def mse(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def nrmse(p: Column, y: Column, strict: bool = False, guarded: bool = True) -> Column:
    """Root mean squared error over the truth's population deviation; a constant truth gives null, or an error if
    ``strict``; a NaN or infinity raises unless ``guarded`` is off."""
    p, y = _finite(guarded, p, y)
    spread = F.stddev_pop(y)
    if strict:
        spread = F.when(spread == 0, F.raise_error(F.lit("zero variance in the truth"))).otherwise(spread)
    return F.try_divide(F.sqrt(mse(p, y)), spread)


def nmse(p: Column, y: Column) -> Column:
    return F.try_divide(mse(p, y), F.var_pop(y))


def mae(p: Column, y: Column) -> Column:
    return F.avg(F.abs(p - y))


def accuracy(p: Column, y: Column, guarded: bool = True) -> Column:
    """The share of predictions on the truth's side of one half; a NaN or infinity raises unless ``guarded`` is off."""
    p, y = _finite(guarded, p, y.cast("double"))
    return F.avg((binarised(p) == y).cast("double"))


def unbiased_variance(x: Column) -> Column:
    """Variance with divisor max(n - 1, 1): a single value has variance 0."""
    return F.when(F.count(x) > 0, F.coalesce(F.var_samp(x), F.lit(0.0)))
