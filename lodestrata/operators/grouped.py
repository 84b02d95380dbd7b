"""Kernels per group that have no expression form: each group is one channel or section of bounded size, or gives sums that are."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import comb, exp, isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from .metrics import _null_safe

#: Training rows of a channel that one task solves as they are, features that stand for more of them, and rows of one task's sums.
DENSE, FEATURES, ROWS = 1024, 2048, 1 << 13
NOISES = (0.01, 0.1, 1.0)


def per_channel(df: DataFrame, channel: str, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fit for every channel on its own, in parallel. A channel's rows meet in one task: meant for pooled tables."""
    return df.groupBy(channel).applyInPandas(fit, schema)


def gp_regression(train: pd.DataFrame, test: pd.DataFrame, coords: list[str], target: str, scale: float, noises: tuple[float, ...] = NOISES) -> tuple[np.ndarray, float]:
    """Posterior mean at the test points of a Gaussian process with a squared-exponential kernel; the noise that scores
    best on every fifth training point is used. Returns the mean and that noise."""

    def kernel(a, b):
        d2 = sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1]))  # one axis at a time: n x m at most
        return np.exp(-d2 / (2 * scale * scale))

    x, y = train[coords].to_numpy(float), train[target].to_numpy(float)
    held = np.arange(len(x)) % 5 == 4
    mean = y.mean() if len(y) else 0.0
    best = (-np.inf, noises[0])
    for noise in noises:
        if held.any() and (~held).any():
            k = kernel(x[~held], x[~held]) + noise * np.eye((~held).sum())
            p = kernel(x[held], x[~held]) @ np.linalg.solve(k, y[~held] - mean) + mean
            best = max(best, (-float(((p - y[held]) ** 2).mean()), noise))
    noise = best[1]
    weights = np.linalg.solve(kernel(x, x) + noise * np.eye(len(x)), y - mean)
    return kernel(test[coords].to_numpy(float), x) @ weights + mean, noise


class _Powers:
    """The squared-exponential kernel around a centre as an inner product of damped powers, total degrees ascending until what is left out of rows within a
    radius is under 1e-15: exp(-(x - y)^2 / 2 s^2) = exp(-x^2 / 2 s^2) exp(-y^2 / 2 s^2) sum of (x.y / s^2)^k / k!."""

    def __init__(self, centre: list[float], scale: float, square: float):
        self.centre, self.scale, dims = np.array(centre), scale, len(centre)
        z = square / (scale * scale)
        self.degree, self.size = 0, FEATURES + 1
        if not isfinite(z) or z > 500:
            return
        term = exp(-z)
        # past the mean of a Poisson count, its tail is under two terms more
        while self.degree < 2 * z or 2 * term > 1e-15:
            self.degree += 1
            term *= z / self.degree
        self.size = comb(self.degree + dims, dims)

    def of(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "exponents"):  # made in the task
            self.exponents = np.array([e for e in product(range(self.degree + 1), repeat=x.shape[1]) if sum(e) <= self.degree])
        z = (x - self.centre) / self.scale
        out = np.exp(-0.5 * (z * z).sum(axis=1))[:, None] * np.ones((1, self.size))
        for i in range(z.shape[1]):
            one = np.ones((len(z), self.degree + 1))
            for k in range(1, self.degree + 1):
                one[:, k] = one[:, k - 1] * z[:, i] / np.sqrt(k)
            out *= one[:, self.exponents[:, i]]
        return out


def gp_by_channel(pooled: DataFrame, channel: str, coords: list[str], target: str, split: str, key: str, scale: float) -> DataFrame:
    """(channel, key, prediction, noise) for rows whose split is 'test', fitted to those whose split is 'train'; of these, in the order of their key, every fifth
    is held out to choose the noise.

    Channels of more than DENSE training rows are solved through their sums over features that give the kernel to rounding, added up block by block,
    if these are no more than FEATURES and the rows; else a channel is solved in one task.
    """
    kinds = dict(pooled.dtypes)
    schema = f"{channel} {kinds[channel]}, {key} {kinds[key]}, prediction double, noise double"

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        a, b = f[f[split] == "train"], f[f[split] == "test"]
        if not len(a) or not len(b):
            return pd.DataFrame({channel: [], key: [], "prediction": [], "noise": []})
        p, noise = gp_regression(a, b, coords, target, scale)
        return pd.DataFrame({channel: b[channel], key: b[key], "prediction": p, "noise": noise})

    sizes = pooled.where(F.col(split) == "train").groupBy(channel).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(target).cast("double")).alias("_mean"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= DENSE:
        return per_channel(pooled, channel, fit, schema)
    ends = pooled.agg(*[f(F.col(c).cast("double")) for c in coords for f in (F.min, F.max)]).first()
    centre = [(ends[2 * i] + ends[2 * i + 1]) / 2 if ends[2 * i] is not None else 0.0 for i in range(len(coords))]
    square = pooled.agg(F.max(sum(F.pow(F.col(c).cast("double") - m, F.lit(2.0)) for c, m in zip(coords, centre, strict=True)))).first()[0]
    way = _Powers(centre, scale, square if square is not None else float("nan"))
    if way.size > min(FEATURES, most):
        return per_channel(pooled, channel, fit, schema)
    marked = cut(_null_safe(pooled.select(channel, key, split, target, *coords), sizes, [channel], "left"), "channels")
    large = F.coalesce(F.col("_n") > max(DENSE, way.size), F.lit(False))
    few = per_channel(marked.where(~large).drop("_n", "_mean"), channel, fit, schema)
    return few.unionByName(_by_sums(marked.where(large), channel, coords, target, split, key, way))


def _by_sums(rows: DataFrame, channel: str, coords: list[str], target: str, split: str, key: str, way: _Powers) -> DataFrame:
    from .bins import global_rank

    kinds, m, step = dict(rows.dtypes), way.size, 64
    block = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / ROWS)).cast("int").alias("_b")
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(coords)]
    ranked = cut(global_rank(rows.where(F.col(split) == "train").select(channel, key, block, *numbers, (F.col(target) - F.col("_mean")).alias("_y")), [channel, key], "_r"), "ranked")
    first = ranked.groupBy(channel).agg(F.min("_r").alias("_first"))
    train = _null_safe(ranked, first, [channel]).withColumn("_held", (F.col("_r") - F.col("_first")) % 5 == 4)
    place = lambda t: np.column_stack([t.column(f"_x{i}").to_numpy() for i in range(len(coords))])

    def sums(t: pa.Table) -> pa.Table:
        x, y, held = place(t), t.column("_y").to_numpy(), t.column("_held").to_numpy()
        total = np.zeros((m + 1, 2 * (m + 1)))  # features and target against themselves: rows fitted to, rows held out
        for at in range(0, len(x), 4096):
            both = np.column_stack([way.of(x[at : at + 4096]), y[at : at + 4096]])
            for k, own in enumerate((~held[at : at + 4096], held[at : at + 4096])):
                total[:, k * (m + 1) : (k + 1) * (m + 1)] += both[own].T @ both[own]
        at = range(0, m + 1, step)
        return pa.table({channel: pa.concat_arrays([t.column(channel)[:1].combine_chunks()] * len(at)), "r": pa.array(list(at), pa.int32()), "v": pa.array([total[k : k + step].tobytes() for k in at], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in t.column("v").to_pylist())
        return t.slice(0, 1).set_column(2, "v", pa.array([total.tobytes()], pa.binary()))

    def solve(t: pa.Table) -> pa.Table:
        total = np.concatenate([np.frombuffer(v) for v in t.sort_by("r").column("v").to_pylist()]).reshape(m + 1, 2, m + 1)
        rest, held = total[:, 0], total[:, 1]
        best = (-np.inf, NOISES[0])
        for noise in NOISES:
            w = np.linalg.solve(rest[:m, :m] + noise * np.eye(m), rest[:m, m])
            best = max(best, (-float(w @ held[:m, :m] @ w - 2 * w @ held[:m, m] + held[m, m]), noise))
        whole = rest + held
        w = np.linalg.solve(whole[:m, :m] + best[1] * np.eye(m), whole[:m, m])
        return pa.table({channel: t.column(channel)[:1], "noise": [best[1]], "w": pa.array([w.tobytes()], pa.binary())})

    named = f"{channel} {kinds[channel]}"
    # blocks are few bytes and much work: dealt out by number, so that small ones are not put together
    many = rows.groupBy(channel).agg(F.ceil(F.max("_n") / ROWS).alias("_k")).agg(F.sum("_k")).first()[0] or 1
    parts = train.select(channel, "_b", *[f"_x{i}" for i in range(len(coords))], "_y", "_held").repartition(4 * many, channel, "_b").groupBy(channel, "_b").applyInArrow(sums, f"{named}, r int, v binary")
    solved = cut(parts.groupBy(channel, "r").applyInArrow(add, f"{named}, r int, v binary").groupBy(channel).applyInArrow(solve, f"{named}, noise double, w binary"), "weights")

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        w, x = np.frombuffer(right.column("w")[0].as_py()) if right.num_rows else np.zeros(m), place(left)
        made = [way.of(x[at : at + 4096]) @ w for at in range(0, len(x), 4096)]
        p = np.concatenate([*made, np.zeros(0)]) + left.column("_mean").to_numpy()
        noise = right.column("noise")[0].as_py() if right.num_rows else 0.0
        return pa.table({channel: left.column(channel), key: left.column(key), "prediction": p, "noise": np.full(len(p), noise)})

    new = cut(rows.where(F.col(split) == "test").select(channel, key, block, *numbers, "_mean"), "new")
    blocks = cut(_null_safe(new.select(channel, "_b").distinct(), solved, [channel]), "blocks")
    new, blocks = (df.repartition(many, channel, "_b") for df in (new, blocks))
    return new.groupBy(channel, "_b").cogroup(blocks.groupBy(channel, "_b")).applyInArrow(predict, f"{named}, {key} {kinds[key]}, prediction double, noise double")


def wiener(coefficients: np.ndarray, density: np.ndarray, noise: float) -> np.ndarray:
    """Spectral smoothing: each mode's coefficient times density / (density + noise)."""
    return coefficients * density / (density + noise)


def spectral_log_likelihood(coefficients: np.ndarray, density: np.ndarray, noise: float, n: int, residual: float) -> float:
    """Log marginal likelihood from mode coefficients; residual is the squared norm outside the modes."""
    var = density + noise
    m = len(density)
    return float(-0.5 * ((coefficients**2 / var).sum() + np.log(var).sum() + residual / noise + (n - m) * np.log(noise) + n * np.log(2 * np.pi)))


def envelope(signal: np.ndarray) -> np.ndarray:
    """Size of the analytic signal along the last axis."""
    n = signal.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(signal, axis=-1) * h, axis=-1))
