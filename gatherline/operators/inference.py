"""Statistical inference by group: paired tests, ranks, bootstrap intervals, Holm's correction, sample sizes."""

from __future__ import annotations

from hashlib import md5
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.functions.distributions import normal_cdf, normal_ppf, student_t_p, wilcoxon_p
from gatherline.functions.draws import digest, seeded
from gatherline.functions.scoring import require_finite
from gatherline.operators.blocks import BLOCK_ROWS, running
from gatherline.operators.series import over_keys
from gatherline.sources.scratch import written

GROUP = ("grp",)


def paired(pairs: DataFrame, group=GROUP, strict: bool = False) -> DataFrame:
    """``n, mean_diff, std_diff, t, p, d`` of ``a - b`` by group. Constant differences give d 0, and t and p NaN if all
    are zero. A group of one pair has nulls, or raises if ``strict``."""
    diff = F.col("a") - F.col("b")
    out = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*group).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("std_diff"))
    if strict:
        out = out.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("a paired test needs two pairs"))).otherwise(F.col("n")))
    flat = F.when(F.col("mean_diff") == 0, float("nan")).otherwise(F.signum("mean_diff") * float("inf"))
    t = F.when(F.col("std_diff") == 0, flat).otherwise(F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n")))
    out = out.withColumn("t", t).withColumn("d", F.when(F.col("std_diff") == 0, 0.0).otherwise(F.col("mean_diff") / F.col("std_diff")))
    return out.withColumn("p", student_t_p(F.col("t"), F.col("n") - 1))


def one_sided(mean_diff: Column, p: Column) -> Column:
    """The p of "a is larger" from a two-sided one."""
    return F.when(mean_diff > 0, p / 2).otherwise(1 - p / 2)


def wilcoxon(pairs: DataFrame, group=GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``n, statistic, ties, z, p`` of the signed-rank test: zero differences dropped, mean ranks, smaller rank sum.

    Differences of one size are merged where they are read; a size's mean rank is what lies below it and half its own
    count, by a running total that has no limit of group size. ``ties``, a sum of cubes, is summed as a decimal: a double
    rounds it beyond 2**53, which some 200,000 differences of one size reach. Beyond 2**63 it raises; ``z`` and ``p`` go on.
    """
    d = F.col("a") - F.col("b")
    sizes = written(pairs.select(*group, d.alias("d")).where("d <> 0").groupBy(*group, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("c_up")))
    ranked = running(sizes, group, ["size"], F.col("c"), "below", "n", block_rows).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    c = F.col("c").cast("decimal(12,0)")
    out = ranked.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.col("c_up") * F.col("rank")).alias("up"), F.sum((F.col("c") - F.col("c_up")) * F.col("rank")).alias("down"), F.sum((c * c * c).cast("decimal(38,0)") - c).cast("decimal(38,0)").alias("ties"))
    n = F.col("n")
    out = out.withColumn("statistic", F.least("up", "down"))
    z = F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.sqrt((n.cast("double") * (n + 1) * (2 * n + 1) - F.col("ties").cast("double") / 2) / 24))
    return out.select(*group, "n", F.col("ties").cast("bigint").alias("ties"), "statistic", z.alias("z"), wilcoxon_p("statistic", n.cast("double"), F.col("ties").cast("double")).alias("p"))


#: Values that the draws meet by broadcast. Of more, a task holds the values of a group of up to HELD; larger groups' values
#: meet the draws by an exchange.
BROADCAST_VALUES, HELD = 1_000_000, 1 << 22
#: Digests, of four draws each, that a row of the plan stands for, or that are opened at a time.
CHUNK = 4096
#: Values in a row on their way to the tasks that hold them, and draws of such a task, about.
PACK, UNIT = 1024, 25_000_000


class _Resamples:
    """The values of a group in the order of their numbers, and then the means of some of its resamples."""

    def __init__(self, key):
        self.parts = []

    def feed(self, c: dict) -> None:
        self.parts += list(c["_xs"])
        self.head, self.first, self.last = c["_head"][0], int(c["_first"][0]), int(c["_last"][0])

    def end(self) -> dict:
        x = np.concatenate(self.parts)
        tails, means = [b":%d" % q for q in range(-(-len(x) // 4))], []
        for b in range(self.first, self.last + 1):
            head, total = f"{self.head}:{b}".encode(), 0.0
            for q in range(0, len(tails), CHUNK):
                digests = b"".join([md5(head + t, usedforsecurity=False).digest() for t in tails[q : q + CHUNK]])
                total += x[np.frombuffer(digests, ">u4")[: len(x) - 4 * q].astype(np.uint32) % np.uint32(len(x))].sum()
            means.append(total / len(x))
        return {"b": np.arange(self.first, self.last + 1, dtype=np.int32), "mean": means}


def _held_means(numbered: DataFrame, keys: list[str], resamples: int, seed: int, tasks: int) -> DataFrame:
    """The means of groups that fit a task: packed values go to each task that draws some of their group's resamples."""
    packed = numbered.groupBy(*keys, F.floor(F.col("_i") / PACK).alias("_block")).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_xs"))
    each = F.greatest(F.lit(1), F.least(F.lit(resamples), F.floor(UNIT / F.col("_n")))).cast("int")
    units = packed.withColumn("_each", each).withColumn("_unit", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(resamples) / F.col("_each")).cast("int") - 1)))
    first = F.col("_unit") * F.col("_each") + 1
    units = units.select(*keys, "_unit", "_block", F.col("_xs._x").alias("_xs"), seeded(seed, *[F.col(k) for k in keys]).alias("_head"), first.alias("_first"), F.least(first + F.col("_each") - 1, F.lit(resamples)).alias("_last"))
    return over_keys(units.repartition(tasks, *keys, "_unit"), (*keys, "_unit"), ("_block",), _Resamples, "b int, mean double").drop("_unit")


def boot_means(values: DataFrame, group=GROUP, order: str = "pair_id", value: str = "x", resamples: int = 1000, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``*group, b, mean``: means of ``resamples`` draws with replacement of each group's values, ordered by ``order``.

    Values are numbered within their group. Of up to BROADCAST_VALUES values in all, and of groups beyond HELD, draws are
    rows: of each resample's md5 digests, four draws each, CHUNK are a row of the plan that is dealt to a task, opened
    there and joined to the values by number. Sums combine where they are drawn, so no row or task holds a group. Other groups'
    values go, packed, to the tasks that draw their resamples. A value that isn't finite raises.
    """
    keys = list(group)
    rows = written(values.select(*keys, F.col(order).alias("_o"), require_finite(F.col(value), value).cast("double").alias("_x")))
    numbered = running(rows, group, ["_o", "_x"], before="_i", total="_n", block_rows=block_rows)
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    every, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    few = every <= BROADCAST_VALUES
    cores, held = values.sparkSession.sparkContext.defaultParallelism, None
    if not few:
        held = _held_means(numbered.where(F.col("_n") <= HELD), keys, resamples, seed, max(cores, every * resamples // UNIT))
        if most <= HELD:
            return held
        sizes, numbered = sizes.where(F.col("_n") > HELD), numbered.where(F.col("_n") > HELD)
    tasks = max(cores, int(every * resamples // 100_000_000))
    last = F.floor((F.col("_n") - 1) / 4)
    plan = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / CHUNK))).alias("_chunk")).repartition(tasks, *keys, "b", "_chunk")
    first = F.col("_chunk") * CHUNK
    digests = plan.select(*keys, "_n", "b", F.explode(F.sequence(first, F.least(first + CHUNK - 1, last))).alias("_q"))
    digests = digests.select(*keys, "_n", "b", "_q", digest(seed, *[F.col(g) for g in keys], F.col("b"), F.col("_q")).alias("_h"))
    drawn = lambda part: F.when(4 * F.col("_q") + part < F.col("_n"), F.conv(F.substring("_h", 8 * part + 1, 8), 16, 10).cast("bigint") % F.col("_n"))
    draws = digests.select(*keys, "_n", "b", F.explode(F.array(*map(drawn, range(4)))).alias("_i")).where("_i IS NOT NULL")
    numbered = numbered.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_i").alias("_at"), "_x")
    same = F.col("_i") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # the draws open from a small table, by whose size Spark would broadcast them
    met = draws.join(F.broadcast(numbered), same) if few else draws.hint("merge").join(numbered, same)
    out = met.groupBy(*keys, "b").agg((F.sum("_x") / F.max("_n")).alias("mean"))
    return out if held is None else out.unionByName(held)


def bootstrap_ci(values: DataFrame, group=GROUP, level: float = 0.95, **how) -> DataFrame:
    """``low, high``: linearly interpolated percentiles of the bootstrap means."""
    tail = (1 - level) / 2
    out = boot_means(values, group, **how).groupBy(*group).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return out.select(*group, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _interpolated(xs: Column, q: Column) -> Column:
    """The quantile ``q`` of a sorted array, by linear interpolation."""
    at = q * (F.size(xs) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(xs, low), F.coalesce(F.get(xs, low + 1), F.get(xs, low))
    return a + (at - low) * (b - a)


def bca_ci(values: DataFrame, group=GROUP, level: float = 0.95, value: str = "x", **how) -> DataFrame:
    """``mean, low, high``: bias-corrected and accelerated interval; groups under three values give nulls.

    For a mean the jackknife has a closed form: acceleration is the third central moment's sum over six times the
    second's to the power 1.5, which is the skewness over six times the root of n.
    """
    values = values.withColumn(value, require_finite(F.col(value), value))
    stats = values.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.skewness(value).alias("skew"))
    stats = stats.withColumn("accel", F.coalesce(F.nanvl("skew", F.lit(0.0)) / (6 * F.sqrt("n")), F.lit(0.0)))
    boots = boot_means(values, group, value=value, **how).groupBy(*group).agg(F.array_sort(F.collect_list("mean")).alias("means"))
    out = stats.join(boots, list(group))
    below = F.size(F.filter("means", lambda x: x < F.col("mean"))) / F.size("means")
    out = out.withColumn("z0", normal_ppf(F.least(F.greatest(below, F.lit(1e-10)), F.lit(1 - 1e-10))))
    for name, q in (("low", (1 - level) / 2), ("high", 1 - (1 - level) / 2)):
        z = F.col("z0") + NormalDist().inv_cdf(q)
        at = normal_cdf(F.col("z0") + z / (1 - F.col("accel") * z))
        out = out.withColumn(name, F.when(F.col("n") >= 3, _interpolated(F.col("means"), F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)))))
    return out.select(*group, "n", "mean", "low", "high")


def holm(pvalues: DataFrame, family=("family",), p: str = "p", strict: bool = True) -> DataFrame:
    """``adjusted``: Holm's step-down correction in each family; a p outside [0, 1] raises, or gives null."""
    bad = F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    if strict:
        pvalues = pvalues.withColumn(p, F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]"))).otherwise(F.col(p)))
    order = Window.partitionBy(*family).orderBy(p)
    left = F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1
    rows = pvalues.withColumn("_scaled", left * F.col(p))
    highest = F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("adjusted", F.least(F.lit(1.0), highest)).drop("_scaled")


def sample_size(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Pairs needed to see ``effect`` (two-sided); null for effects that aren't positive."""
    if not (0 < alpha < 1 and 0 < power < 1):
        raise ValueError("alpha and power must lie in (0, 1)")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(effect > 0, F.ceil(F.pow(F.lit(z) / effect, F.lit(2.0)))).cast("bigint")


def effect_rule(effect: Column, low: Column, high: Column, least: float) -> Column:
    """Is the effect large enough, and its interval on the same side of 0? ``least`` < 0 asks for a decrease."""
    met, side = (effect >= least, low > 0) if least > 0 else (effect <= least, high < 0)
    return F.when(met & side, "met").when(met, "inconclusive").otherwise("not_met")
