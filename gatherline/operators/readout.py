"""Linear readouts: ridge with blocked cross-validation from sufficient statistics, prediction, and grid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.operators.blocks import running
from gatherline.operators.features import leaky_states, leaky_weights
from gatherline.operators.runs import captured
from gatherline.operators.series import fold_ids, over_keys

ALPHAS = (1e-8, 1e-6, 1e-4, 1e-2, 1.0, 100.0)
WARM_UP = 10
STATS = "series_id {0}, fold int, n bigint, sx array<double>, sy array<double>, sxx array<double>, sxy array<double>, syy array<double>"


def _sums(key, x: np.ndarray, y: np.ndarray) -> dict:
    return {"series_id": key[0], "fold": key[1], "n": len(x), "sx": x.sum(0), "sy": y.sum(0), "sxx": (x.T @ x).ravel(), "sxy": (x.T @ y).ravel(), "syy": (y * y).sum(0)}


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


#: Numbers of sums that a task holds before it puts them out, and places in which a series' sums are added up first.
HELD, PLACES = 4_000_000, 16


def partial_statistics(rows: DataFrame) -> DataFrame:
    """For each ``series_id`` and ``fold``, in up to PLACES rows: n, and sums of x, y, xx', xy' and y*y.

    ``rows(series_id, fold, x ARRAY, y ARRAY)``, read once and summed up where they are read, over all batches of a
    task; then as a tree, over PLACES tasks for each series and fold, so no task gets a row of every other. A null fold
    (rows in no validation block) is fold -1. Sums of a series and fold add up to its statistics.
    """
    kind = rows.schema["series_id"].dataType.simpleString()

    def out(sums: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = {"series_id": batch.schema.field(0).type, "fold": pa.int32(), "n": pa.int64()}
        names = ["series_id", "fold", "n", "sx", "sy", "sxx", "sxy", "syy"]
        rows = [dict(zip(names, (*key, *parts), strict=True)) for key, parts in sums.items()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.list_(pa.float64()))) for c in names]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            keys = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
            codes, names = keys.factorize()
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                parts = list(_sums(names[i], x[order[lo:hi]], y[order[lo:hi]]).values())[2:]
                key = tuple(v.item() if isinstance(v, np.generic) else v for v in names[i])
                sums[key] = [a + b for a, b in zip(sums[key], parts, strict=True)] if key in sums else parts
            if len(sums) * (x.shape[1] + 1) * (x.shape[1] + y.shape[1]) > HELD:
                yield out(sums, batch)
                sums.clear()
        if sums:
            yield out(sums, batch)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, []
        for batch in batches:
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                parts = [row[2], *(batch.column(c)[i].values.to_numpy() for c in range(3, 8))]
                if key == row[:2]:
                    total = [a + b for a, b in zip(total, parts, strict=True)]
                    continue
                if key is not None:
                    yield out({key: total}, batch)
                key, total = row[:2], parts
        if key is not None:
            yield out({key: total}, batch)

    some = rows.select("series_id", F.coalesce("fold", F.lit(-1)).alias("fold"), "x", "y")
    sums = some.mapInArrow(partial, STATS.format(kind)).withColumn("_place", F.spark_partition_id() % PLACES)
    placed = sums.repartition("series_id", "fold", "_place").sortWithinPartitions("series_id", "fold").drop("_place")
    return placed.mapInArrow(added, STATS.format(kind))


def _unpack(row) -> list[np.ndarray]:
    f, k = len(row["sx"]), len(row["sy"])
    return [np.array(row["n"], float), np.array(row["sx"]), np.array(row["sy"]), np.array(row["sxx"]).reshape(f, f), np.array(row["sxy"]).reshape(f, k), np.array(row["syy"])]


def solve(stats: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (features x targets) and intercepts of centred ridge regression."""
    n, sx, sy, sxx, sxy, _ = stats
    a, b = sxx - np.outer(sx, sx) / n + alpha * np.eye(len(sx)), sxy - np.outer(sx, sy) / n
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    return w, (sy - sx @ w) / n


def scored_alphas(train: list[np.ndarray], held: list[np.ndarray], alphas) -> list[float]:
    """The held-out R2 of each alpha: one eigendecomposition of the training rows' moments serves them all.

    Where alphas are many orders below the largest eigenvalue, the small eigenvalues' rounding counts; ``solve`` then
    fits the alpha that was chosen from the moments themselves.
    """
    n, sx, sy, sxx, sxy, _ = train
    values, vectors = np.linalg.eigh(sxx - np.outer(sx, sx) / n)
    turned = vectors.T @ (sxy - np.outer(sx, sy) / n)
    out = []
    for alpha in alphas:
        w = vectors @ (turned / (np.maximum(values, 0.0) + alpha)[:, None]) if alpha > 0 else solve(train, alpha)[0]
        out.append(r2(held, w, (sy - sx @ w) / n))
    return out


def r2(stats: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> float:
    """Mean R2 over targets, from a block's sums alone; a constant target counts 1 if met exactly, else 0."""
    n, sx, sy, sxx, sxy, syy = stats
    sse = syy - 2 * (w * sxy).sum(0) - 2 * b * sy + np.einsum("fk,fg,gk->k", w, sxx, w) + 2 * b * (sx @ w) + n * b * b
    tss = syy - sy * sy / n
    flat = tss <= 1e-12 * np.maximum(syy, 1e-300)
    return float(np.where(flat, (np.abs(sse) <= 1e-12).astype(float), 1 - sse / np.where(flat, 1, tss)).mean())


FIT = "series_id {0}, target_k int, alpha double, intercept double, coef array<double>"


def fits(rows: DataFrame, alphas=ALPHAS) -> DataFrame:
    """``ridge_cv`` with ``success, failure_reason``: a series whose fit raises or isn't finite has one row with the reason."""
    kind = rows.schema["series_id"].dataType.simpleString()

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[int, list[np.ndarray]] = {}
        for _, r in pdf.iterrows():
            own = _unpack(r)
            blocks[int(r["fold"])] = [a + b for a, b in zip(blocks[int(r["fold"])], own, strict=True)] if int(r["fold"]) in blocks else own
        every = [sum(parts) for parts in zip(*blocks.values(), strict=True)]
        if not all(np.isfinite(part).all() for part in every):
            raise ValueError("sums of features and targets are not finite")
        folds = [f for f in sorted(blocks) if f >= 0]
        best = alphas[0]
        if len(alphas) > 1 and len(folds) > 1:
            score = np.mean([scored_alphas([a - b for a, b in zip(every, blocks[f], strict=True)], blocks[f], alphas) for f in folds], 0)
            best = alphas[int(np.argmax(score))]
        w, b = solve(every, best)
        return pd.DataFrame({"series_id": key[0], "target_k": range(len(b)), "alpha": best, "intercept": b, "coef": list(w.T)})

    safe, schema = captured(one, FIT.format(kind))
    return partial_statistics(rows).groupBy("series_id").applyInPandas(safe, schema)


def ridge_cv(rows: DataFrame, alphas=ALPHAS) -> DataFrame:
    """``series_id, target_k, alpha, intercept, coef`` of each series: the alpha of best mean R2 over its folds, first
    on ties, refitted on all rows. Folds are left out by subtraction; the rows are read once, and one row for each batch,
    series and fold is shuffled. A series that can't be fitted has one row of nulls; ``fits`` says why."""
    return fits(rows, alphas).drop("success", "failure_reason")


def predict(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``series_id, t, k, p, y``: the fits applied to ``rows(series_id, t, x, y ARRAY)``, a row for each target."""
    p = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.col("intercept"), lambda a, v: a + v)
    return rows.join(fits, "series_id").select("series_id", "t", F.col("target_k").alias("k"), p.alias("p"), F.get("y", F.col("target_k")).alias("y"))


def ridge_two(rows: DataFrame, alpha: float, group=("series_id",)) -> DataFrame:
    """``w1, w2, b`` of ridge on two features ``x1, x2`` by Cramer's rule: aggregates only."""
    n = F.count("*")
    c = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    m = rows.groupBy(*group).agg(c("x1", "x1").alias("a"), c("x1", "x2").alias("c"), c("x2", "x2").alias("d"), c("x1", "y").alias("p"), c("x2", "y").alias("q"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg("y").alias("my"))
    m = m.withColumns({"a": F.col("a") + alpha, "d": F.col("d") + alpha})
    det = F.col("a") * F.col("d") - F.col("c") * F.col("c")
    w1, w2 = F.try_divide(F.col("p") * F.col("d") - F.col("q") * F.col("c"), det), F.try_divide(F.col("q") * F.col("a") - F.col("p") * F.col("c"), det)
    m = m.withColumn("w1", w1).withColumn("w2", w2)
    return m.select(*group, "w1", "w2", (F.col("my") - F.col("w1") * F.col("m1") - F.col("w2") * F.col("m2")).alias("b"))


PARAMETERS = ("spectral_radius", "input_scaling", "leak_rate")


def _weights(configs: list, units: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    made = [leaky_weights(units, c["spectral_radius"], c["input_scaling"], seed) for c in configs]
    return np.array([w for w, _ in made]), np.array([v for _, v in made]), np.array([c["leak_rate"] for c in configs])


#: Steps whose states are held at once.
STEPS = 256


class _Moments:
    """Means and centred products of x and a target for many systems at once, joined piece by piece (Chan et al. 1979)."""

    def __init__(self, systems: int, units: int):
        self.n, self.x, self.t = 0, np.zeros((systems, units)), np.zeros(systems)
        self.xx, self.xt = np.zeros((systems, units, units)), np.zeros((systems, units))

    def add(self, x: np.ndarray, t: np.ndarray) -> None:
        """``x``: time by systems by units, ``t``: time."""
        if not len(t):
            return
        mean_x, mean_t = x.mean(0), t.mean()
        xc, tc = (x - mean_x).transpose(1, 0, 2), t - mean_t
        n, by = self.n + len(t), self.n * len(t) / (self.n + len(t))
        dx, dt = mean_x - self.x, mean_t - self.t
        self.xx += xc.transpose(0, 2, 1) @ xc + by * dx[:, :, None] * dx[:, None, :]
        self.xt += (xc.transpose(0, 2, 1) @ tc[:, None])[..., 0] + by * dx * dt[:, None]
        self.x, self.t, self.n = self.x + dx * (len(t) / n), self.t + dt * (len(t) / n), n

    def fitted(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.xx + alpha * np.eye(self.x.shape[1]), self.xt[..., None]
        try:
            coef = np.linalg.solve(a, b)[..., 0]
        except np.linalg.LinAlgError:
            coef = np.array([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, b, strict=True)])[..., 0]
        return coef, self.t - (self.x * coef).sum(1)


class _Readout:
    """Leaky states of many systems over a stream of rows: those to learn from first, then those to predict.

    Holds the last states and the systems' moments, and the states of STEPS rows, whatever the series' length.
    """

    def __init__(self, weights: tuple, alpha: float, warm_up: int):
        self.w, self.v, self.leak = weights
        self.alpha, self.warm_up, self.seen, self.fit = alpha, warm_up, 0, None
        self.state, self.moments = np.zeros(self.v.shape), _Moments(*self.v.shape)

    def run(self, u: np.ndarray, y: np.ndarray, learn: np.ndarray):
        """Learns from the rows where ``learn`` holds, and yields for the others ``(slice, predictions)``, time by systems."""
        for at in range(0, len(u), STEPS):
            here = slice(at, at + STEPS)
            states = leaky_states(u[here], self.w, self.v, self.leak, self.state)
            self.state = states[-1]
            cut = int(learn[here].sum())  # the rows to learn from come first
            skip = min(max(self.warm_up - self.seen, 0), cut)
            self.moments.add(states[skip:cut], y[here][skip:cut])
            self.seen += cut
            if cut < len(states):
                if self.fit is None:
                    self.fit = self.moments.fitted(self.alpha)
                coef, b = self.fit
                yield slice(at + cut, at + len(states)), np.einsum("tsu,su->ts", states[cut:], coef) + b


class _FoldErrors:
    """The mean validation error of each configuration on one fold of one series."""

    def __init__(self, weights: tuple, alpha: float):
        self.readout, self.n, self.sse = _Readout(weights, alpha, WARM_UP), 0, np.zeros(len(weights[2]))

    def feed(self, c: dict) -> None:
        for here, p in self.readout.run(c["u"], c["y"], ~c["held"]):
            self.sse += ((p - c["y"][here, None]) ** 2).sum(0)
            self.n += len(p)

    def end(self) -> dict:
        mean = self.sse / self.n if self.n and self.readout.moments.n else np.full(len(self.sse), np.inf)
        return {"place": np.arange(len(mean)), "error": np.where(np.isfinite(mean), mean, np.inf)}


def grid_search(series: DataFrame, configs: DataFrame, units: int = 8, folds: int = 3, alphas=ALPHAS, seed: int = 137) -> DataFrame:
    """``series_id, grid_pos, ..., score``: mean validation error of each configuration of leaky-state features.

    ``series(series_id, t, u, y)``; ``configs`` is a small grid and goes to every task. For each fold, a block by the
    floor rule, the rows outside it are joined: states run over them from 0 and on into the fold; the first WARM_UP rows
    aren't fitted. A task streams one series and fold through all configurations, so memory doesn't grow with the
    series. The smallest alpha is used. A failed fit, and a series too short to fit, score infinite.
    """
    alpha, kind = min(alphas), series.schema["series_id"].dataType
    grid = [r.asDict() for r in configs.orderBy("grid_pos").collect()]  # a parameter grid
    weights = _weights(grid, units, seed)
    rows = fold_ids(series.select("series_id", "t", "u", "y"), folds, balanced=False)
    each = rows.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_f"), "fold", "t", F.col("u").cast("double").alias("u"), F.col("y").cast("double").alias("y"))
    each = each.select("series_id", "_f", F.col("fold").eqNullSafe(F.col("_f")).alias("held"), "t", "u", "y")
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be merged
    errors = over_keys(each.repartition(tasks, "series_id", "_f"), ("series_id", "_f"), ("held", "t"), lambda _: _FoldErrors(weights, alpha), "place bigint, error double")
    mean = F.avg("error")
    scores = errors.groupBy("series_id", "place").agg(F.when(F.isnan(mean), float("inf")).otherwise(mean).alias("score"))
    some = [F.element_at(F.array(*[F.lit(c[p]) for c in grid]), F.col("place").cast("int") + 1).alias(p) for p in ("grid_pos", *PARAMETERS)]
    return scores.select(F.col("series_id").cast(kind).alias("series_id"), *some, "score")


def best_config(scores: DataFrame, strict: bool = True) -> DataFrame:
    """The configuration of lowest score for each series, first in the grid on ties; all infinite raises, if ``strict``."""
    best = scores.groupBy("series_id").agg(F.min_by(F.struct("spectral_radius", "input_scaling", "leak_rate", "grid_pos"), F.struct("score", "grid_pos")).alias("c"), F.min("score").alias("score"))
    score = F.when(F.col("score") == float("inf"), F.raise_error(F.lit("no configuration could be fitted"))).otherwise(F.col("score")) if strict else F.col("score")
    return best.select("series_id", "c.*", score.alias("score"))


class _Refit:
    """Predictions of one series' last rows from a readout fitted on the first."""

    def __init__(self, units: int, alpha: float, seed: int):
        self.units, self.alpha, self.seed, self.readout = units, alpha, seed, None

    def feed(self, c: dict) -> dict | None:
        if self.readout is None:
            config = {p: float(c[p][0]) for p in PARAMETERS}
            # of a series as short as the warm-up the last row to learn from counts
            self.readout = _Readout(_weights([config], self.units, self.seed), self.alpha, min(WARM_UP, max(int(c["cut"][0]) - 1, 0)))
        parts = list(self.readout.run(c["u"], c["y"], c["is_train"]))
        if not parts:
            return None
        some = slice(parts[0][0].start, parts[-1][0].stop)
        return {"t": c["t"][some], "p": np.concatenate([p[:, 0] for _, p in parts]), "y": c["y"][some]}

    def end(self) -> None:
        return None


def refit_best(series: DataFrame, best: DataFrame, train_frac: float = 0.7, units: int = 8, alphas=ALPHAS, seed: int = 137, capture: bool = False) -> DataFrame:
    """``series_id, t, p, y`` on each series' last rows, from its best configuration refitted on the first.

    Rows stream through, so memory doesn't grow with the series. ``capture`` is that of ``over_keys``.
    """
    alpha = min(alphas)
    cut = F.floor(F.col("_total") * F.lit(train_frac))
    rows = running(series.select("series_id", F.col("t").cast("bigint").alias("t"), F.col("u").cast("double").alias("u"), F.col("y").cast("double").alias("y")), ("series_id",), ["t"])
    rows = rows.join(best.select("series_id", *PARAMETERS), "series_id")
    rows = rows.select("series_id", "t", "u", "y", cut.cast("bigint").alias("cut"), (F.col("_before") < cut).alias("is_train"), *PARAMETERS)
    return over_keys(rows.repartition("series_id"), ("series_id",), ("t",), lambda _: _Refit(units, alpha, seed), "t bigint, p double, y double", capture)
