"""A sparse Gaussian-process prior over many tasks: shared inducing points, and for every task a Gaussian over its values there.

All that the data say about the posterior are sums over rows: of kernel vectors against each other and against the tasks' values. One pass makes them, as a
matrix where the rows lie, added up row by row of the matrix. Natural-gradient steps then move each task's posterior towards the one those
sums ask for, and the bound on the likelihood follows from them without another pass. The driver holds matrices of the inducing points only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .local_gp import matern

#: Inducing points at most: their square is what a task and the driver hold.
MOST_INDUCING = 2048
JITTER = 1e-8


def kernel(a: np.ndarray, b: np.ndarray, scales: np.ndarray, nu: float) -> np.ndarray:
    gap = a[:, None, :] / scales - b[None, :, :] / scales
    return matern(np.sqrt((gap * gap).sum(axis=2)), nu)


class SparseTasks:
    """q(u) = N(mean, cov) per task over the inducing values u, under a Matern prior of a variance per task and Gaussian noise per task.

    fit() keeps the bound after every step in `bounds`. With a step of 1 the first step is exact; with all rows as inducing
    points the posterior is the exact process's. A task whose value is null in a row learns nothing from that row's
    zero weight: rows with a null are left out for all tasks.
    """

    def __init__(self, inducing: np.ndarray, scales: list[float], variances: list[float], noises: list[float], nu: float = 2.5):
        if len(inducing) > MOST_INDUCING:
            raise ValueError(f"more than {MOST_INDUCING} inducing points: choose fewer, for instance centres of clusters")
        self.z, self.scales, self.nu = np.asarray(inducing, dtype=float), np.asarray(scales, dtype=float), nu
        self.variances, self.noises = np.asarray(variances, dtype=float), np.asarray(noises, dtype=float)

    def _sums(self, train: DataFrame, coords: list[str], tasks: list[str]) -> None:
        z, scales, nu, m, c = self.z, self.scales, self.nu, len(self.z), len(tasks)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, m + c))
            rest = np.zeros(m + c)
            for batch in batches:
                x = np.column_stack([batch.column(k).to_numpy() for k in coords])
                y = np.column_stack([batch.column(k).to_numpy() for k in tasks])
                k = kernel(x, z, scales, nu)
                total += k.T @ np.hstack([k, y])
                rest[0] += len(x)
                rest[1 : 1 + c] += (y * y).sum(axis=0)
            r = np.arange(m + 1, dtype=np.int32)
            rows = np.vstack([total, rest])
            yield pa.RecordBatch.from_pydict({"r": r, "v": pa.array([v.tobytes() for v in rows], pa.binary())})

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v) for v in rows.column("v").to_pylist())
            return pa.table({"r": rows.column("r")[:1], "v": pa.array([total.tobytes()], pa.binary())})

        narrow = train.select(*[F.col(k).cast("double").alias(k) for k in [*coords, *tasks]]).dropna()
        made = narrow.mapInArrow(of, "r int, v binary").groupBy("r").applyInArrow(add, "r int, v binary").collect()
        whole = np.zeros((m + 1, m + c))
        for row in made:
            whole[row["r"]] = np.frombuffer(row["v"])
        self.kk, self.ky = whole[:m, :m], whole[:m, m:]
        self.n, self.yy = whole[m, 0], whole[m, 1 : 1 + c]

    def fit(self, train: DataFrame, coords: list[str], tasks: list[str], steps: int = 1, step: float = 1.0) -> SparseTasks:
        self.coords, self.tasks = list(coords), list(tasks)
        self._sums(train, coords, tasks)
        m = len(self.z)
        prior = kernel(self.z, self.z, self.scales, self.nu) + JITTER * np.eye(m)
        self.inverse = np.linalg.inv(prior)
        self.log_det = np.linalg.slogdet(prior)[1]
        self.bounds: list[list[float]] = []
        theta = []
        for c in range(len(tasks)):
            p = self.inverse / self.variances[c]
            theta.append((np.zeros(m), p))
        # kernel vectors carry the variance of their task, so do the sums; through the inverse one factor cancels
        project = self.inverse @ self.kk @ self.inverse
        for _ in range(steps):
            self.mean, self.cov = [], []
            for c in range(len(tasks)):
                target = self.inverse @ self.ky[:, c] / self.noises[c], self.inverse / self.variances[c] + project / self.noises[c]
                theta[c] = tuple((1 - step) * old + step * new for old, new in zip(theta[c], target, strict=True))
                cov = np.linalg.inv(theta[c][1])
                self.cov.append((cov + cov.T) / 2)
                self.mean.append(self.cov[-1] @ theta[c][0])
            self.bounds.append([self.bound(c) for c in range(len(tasks))])
        return self

    def bound(self, c: int) -> float:
        """The evidence bound of a task under its present posterior."""
        mean, cov, s2, noise = self.mean[c], self.cov[c], self.variances[c], self.noises[c]
        project = self.inverse @ self.kk @ self.inverse
        square = self.yy[c] - 2 * mean @ self.inverse @ self.ky[:, c] + mean @ project @ mean + np.trace(project @ cov)
        missing = s2 * (self.n - np.trace(self.inverse @ self.kk))
        fit = -0.5 * (self.n * np.log(2 * np.pi * noise) + (square + missing) / noise)
        m = len(mean)
        kl = 0.5 * (np.trace(self.inverse @ cov) / s2 + mean @ self.inverse @ mean / s2 - m + self.log_det + m * np.log(s2) - np.linalg.slogdet(cov)[1])
        return float(fit - kl)

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, task, mean, variance) of every row with coordinates; variance is that of a new measurement."""
        z, scales, nu, inverse, tasks, coords = self.z, self.scales, self.nu, self.inverse, self.tasks, self.coords
        parts = [(self.mean[c], self.cov[c], self.variances[c], self.noises[c]) for c in range(len(tasks))]

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(k).to_numpy() for k in coords])
                k = kernel(x, z, scales, nu)
                w = k @ inverse
                for task, (mean, cov, s2, noise) in zip(tasks, parts, strict=True):
                    variance = s2 * (1 - (w * k).sum(axis=1)) + ((w @ cov) * w).sum(axis=1) + noise
                    yield pa.RecordBatch.from_pydict({key: batch.column(key), "task": [task] * len(x), "mean": w @ mean, "variance": variance})

        kind = df.schema[key].dataType.simpleString()
        narrow = df.select(key, *[F.col(k).cast("double").alias(k) for k in coords]).dropna(subset=coords)
        return narrow.mapInArrow(of, f"{key} {kind}, task string, mean double, variance double")
