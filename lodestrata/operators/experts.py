"""A mixture of linear experts with Gaussian gates, fitted by expectation and maximisation over weighted normal equations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6


class MixtureOfExperts:
    """p(x, y) = sum over experts of share * N(x; gate mean, gate deviations) * N(y; weights on (1, x), noise).

    A round is one pass: responsibilities where the rows lie, and from them each expert's weighted moments of (1, x, y), whose sums alone
    reach the driver and solve for all parameters in closed form. `likelihoods` holds the log-likelihood under the parameters that each round began
    with; it never falls. Rows with nulls are left out.
    """

    def __init__(self, experts: int, rounds: int = 50, tolerance: float = 1e-6, seed: int = 0):
        self.experts, self.rounds, self.tolerance, self.seed = experts, rounds, tolerance, seed

    def _logs(self, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        out = np.log(self.share)[None, :] - 0.5 * (((x[:, None, :] - self.mean) ** 2 / self.var).sum(axis=2) + np.log(2 * np.pi * self.var).sum(axis=1))
        if y is not None:
            at = np.column_stack([np.ones(len(x)), x]) @ self.weights.T
            out -= 0.5 * ((y[:, None] - at) ** 2 / self.noise + np.log(2 * np.pi * self.noise))
        return out

    def fit(self, train: DataFrame, features: list[str], target: str) -> MixtureOfExperts:
        d, e = len(features), self.experts
        rows = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y")).dropna()
        self.features = list(features)
        first = rows.agg(*[f(f"x{i}") for i in range(d) for f in (F.avg, F.var_pop)], F.avg("y"), F.var_pop("y")).first()
        if first[0] is None:
            raise ValueError("no rows to fit")
        centre, spread = np.array(first[0 : 2 * d : 2], dtype=float), np.maximum(np.array(first[1 : 2 * d : 2], dtype=float), FLOOR)
        rng = np.random.default_rng(self.seed)
        self.share = np.full(e, 1.0 / e)
        self.mean = centre + rng.normal(size=(e, d)) * np.sqrt(spread)
        self.var = np.tile(spread, (e, 1))
        self.weights = np.column_stack([np.full(e, float(first[2 * d])), np.zeros((e, d))])
        self.noise = np.full(e, max(float(first[2 * d + 1]), FLOOR))
        self.likelihoods: list[float] = []
        for _ in range(self.rounds):
            sums, score = self._moments(rows, d)
            self.likelihoods.append(score)
            if len(self.likelihoods) > 1 and score - self.likelihoods[-2] <= self.tolerance * abs(score):
                break
            self._maximise(sums, d)
        return self

    def _moments(self, rows: DataFrame, d: int) -> tuple[np.ndarray, float]:
        """Per expert the weighted moments of (1, x, y), and the log-likelihood."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, score = np.zeros((self.experts, d + 2, d + 2)), 0.0
            for batch in batches:
                x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(d)])
                y = batch.column("y").to_numpy()
                logs = self._logs(x, y)
                top = logs.max(axis=1, keepdims=True)
                sums = np.exp(logs - top).sum(axis=1, keepdims=True)
                score += float((top + np.log(sums)).sum())
                r = np.exp(logs - top) / sums
                v = np.column_stack([np.ones(len(x)), x, y])
                total += np.einsum("ne,na,nb->eab", r, v, v, optimize=True)
            at = np.arange(total.size + 1, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"at": at, "s": np.append(total.ravel(), score)})

        out = np.zeros(self.experts * (d + 2) ** 2 + 1)
        for row in rows.mapInArrow(of, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
            out[row["at"]] = row["s"]
        return out[:-1].reshape(self.experts, d + 2, d + 2), float(out[-1])

    def _maximise(self, m: np.ndarray, d: int) -> None:
        n = np.maximum(m[:, 0, 0], 1e-300)
        self.share = np.maximum(m[:, 0, 0], 1e-12)
        self.share = self.share / self.share.sum()
        for e in range(self.experts):
            if m[e, 0, 0] < FLOOR:
                continue  # an expert that no row wants stays as it is
            self.mean[e] = m[e, 0, 1 : d + 1] / n[e]
            self.var[e] = np.maximum(np.diag(m[e])[1 : d + 1] / n[e] - self.mean[e] ** 2, FLOOR)
            a, b = m[e, : d + 1, : d + 1], m[e, : d + 1, d + 1]
            w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
            self.weights[e] = w
            self.noise[e] = max((m[e, d + 1, d + 1] - 2 * w @ b + w @ a @ w) / n[e], FLOOR)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the experts' predictions weighted by their gates; null where a feature is."""
        model = self

        @F.pandas_udf("double")
        def of(*columns):
            import pandas as pd

            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            logs = model._logs(x, None)
            gate = np.exp(logs - logs.max(axis=1, keepdims=True))
            out = (gate * (np.column_stack([np.ones(len(x)), x]) @ model.weights.T)).sum(axis=1) / gate.sum(axis=1)
            return pd.Series(out).where(~np.isnan(out), None)

        return df.withColumn(name, of(*[F.col(c).cast("double") for c in self.features]))
