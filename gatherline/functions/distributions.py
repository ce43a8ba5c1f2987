"""Distribution functions for aggregated rows; Spark has no erf or incomplete beta."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LARGE_DF = 5000
_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda x: _NORMAL.inv_cdf(x) if 0 < x < 1 else math.nan, na_action="ignore")


@F.pandas_udf(DoubleType())
def wilcoxon_p(statistic: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p: by counting sign patterns up to 50 untied differences, else normal with the tie correction."""

    def one(w: float, n: float, tie: float) -> float:
        if not n > 0:
            return math.nan
        n = int(n)
        if n <= 50 and tie == 0:
            ways = [1] + [0] * (n * (n + 1) // 2)
            for k in range(1, n + 1):
                for s in range(len(ways) - 1, k - 1, -1):
                    ways[s] += ways[s - k]
            return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
        spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie / 2) / 24)
        return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else math.nan

    return pd.Series([one(*x) for x in zip(statistic, n, ties, strict=True)])


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom: the finite trigonometric sums (Abramowitz & Stegun
    26.7.3 and 26.7.4); beyond LARGE_DF the normal tail. NaN stays NaN."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    steps = F.when(odd, F.floor((df - 1) / 2) - 1).otherwise(F.floor(df / 2) - 1).cast("int")
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
    start = F.struct(first.alias("term"), F.when(steps >= 0, first).otherwise(F.lit(0.0)).alias("sum"))
    add = lambda a, k: F.struct((a["term"] * ratio(k) * c2).alias("term"), (a["sum"] + a["term"] * ratio(k) * c2).alias("sum"))
    total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, add)["sum"]
    inner = F.when(odd, 2 / math.pi * (angle + F.sin(angle) * total)).otherwise(F.sin(angle) * total)
    small = F.when(F.isnan(t), t).when((df >= 1) & (df <= LARGE_DF), F.greatest(F.lit(0.0), 1 - inner))
    return F.coalesce(small, F.when(df > LARGE_DF, 2 * normal_cdf(-F.abs(t))))
