"""Feature operators: random cosine features and leaky-state features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.functions.draws import normal, uniform
from gatherline.functions.scoring import require_finite
from gatherline.operators.blocks import BLOCK_ROWS
from gatherline.operators.series import evolved


def matched_count(features: DataFrame, pairs: bool = False) -> int:
    """The feature count of a competing table ``x ARRAY``: its arrays' size n, or n + n (n - 1) / 2 with products of pairs.

    Tables whose rows differ in size, and such without rows, raise.
    """
    sizes = features.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes["least"] is None or sizes["least"] != sizes["most"]:
        raise ValueError("the competing table's rows must have one size")
    n = sizes["most"]
    return n + n * (n - 1) // 2 if pairs else n


def cosine_params(spark: SparkSession, n_features: int, sigma: float = 1.0, seed: int = 137, scale: str = "n") -> DataFrame:
    """``j, w, b``: weights of deviation ``sigma / n`` (or, with ``scale='sqrt'``, sigma over its root), offsets in [0, 2 pi)."""
    return spark.range(n_features).select(F.col("id").cast("int").alias("j"), _weight(n_features, sigma, seed, scale, F.col("id")).alias("w"), (2 * math.pi * uniform(seed, "b", F.col("id"))).alias("b"))


def _weight(n: int, sigma: float, seed: int, scale: str, *keys: Column) -> Column:
    return normal(seed, "w", *keys) * (sigma / (max(n, 1) if scale == "n" else math.sqrt(max(n, 1))))


def cosine_features(series: DataFrame, params: DataFrame | list, value: str = "u") -> DataFrame:
    """``x ARRAY<DOUBLE>``: cos(w_j * value + b_j). ``params``: at most a few thousand rows, made part of the plan."""
    rows = params if isinstance(params, list) else [(r["w"], r["b"]) for r in params.orderBy("j").collect()]
    w, b = F.lit([float(r[0]) for r in rows]), F.lit([float(r[1]) for r in rows])
    u = require_finite(F.col(value), value)
    return series.withColumn("x", F.zip_with(w, b, lambda p, q: F.cos(p * u + q)))


def cosine_features_per_row(series: DataFrame, n_features: int, sigma: float = 1.0, seed: int = 137, value: str = "u") -> DataFrame:
    """The control whose parameters are drawn anew for each row, so that nothing is shared over time."""
    key = (F.col("series_id"), F.col("t"))
    each = lambda j: F.cos(normal(seed, "w", *key, j) * (sigma / max(n_features, 1)) * F.col(value) + 2 * math.pi * uniform(seed, "b", *key, j))
    return series.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), each))


def leaky_weights(units: int, spectral_radius: float, input_scaling: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(units, units))
    radius = max(abs(np.linalg.eigvals(w)))
    return w * (spectral_radius / radius if radius else 0.0), input_scaling * rng.uniform(-1, 1, units)


def leaky_states(u: np.ndarray, w: np.ndarray, v: np.ndarray, leak: np.ndarray | float, start: np.ndarray | None = None) -> np.ndarray:
    """``s[t] = (1 - leak) s[t-1] + leak tanh(W s[t-1] + v u[t])``, from 0 or ``start``; for many systems at once.

    ``u``: time, or time by systems; ``w``: (systems by) units by units; ``v``: (systems by) units; ``leak``: for each system.
    """
    leak = np.asarray(leak)[..., None]
    out, s = np.empty((len(u), *v.shape)), np.zeros(v.shape) if start is None else start
    for t, x in enumerate(u):
        s = (1 - leak) * s + leak * np.tanh((w @ s[..., None])[..., 0] + v * np.asarray(x)[..., None])
        out[t] = s
    return out


def leaky_features(series: DataFrame, units: int = 8, spectral_radius: float = 0.9, input_scaling: float = 0.5, leak: float = 0.3, seed: int = 137, value: str = "u01", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series_id, t, x``: leaky-state features, parallel over series and over the blocks of longer ones."""
    w, v = leaky_weights(units, spectral_radius, input_scaling, seed)

    class Leaky:
        def __init__(self, key, state: list[float] | None = None):
            self.last = np.array(state) if state else np.zeros(units)

        def feed(self, u: np.ndarray) -> pa.Array:
            out = leaky_states(u, w, v, leak, self.last)
            self.last = out[-1]
            return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), units).cast(pa.list_(pa.float64()))

        def state(self) -> list[float]:
            return self.last.tolist()

    rows = series.select("series_id", F.col("t").cast("bigint").alias("t"), F.col(value).cast("double").alias("v"))
    return evolved(rows, ("series_id",), Leaky, "array<double>", "x", block_rows).drop("v")
