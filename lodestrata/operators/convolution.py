"""A two-layer graph convolution with trained layers, read out at measurements by inverse distance to their nearest nodes.

prediction = R S relu(S X W + c) V + b: S is the symmetrically normalised affinity with self-loops, R the read-out. S X and R S are worked out
once, as joins. A round then is a forward pass (one join of R S with the hidden values of nodes, one aggregation by measurement) and a backward
pass (the same table joined with the residuals, aggregated by node). V and b are solved exactly from the forward pass's moments, so only W and c
need steps; their gradient is a sum over nodes. Tables hold everything but the weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, release
from .eigen import _moments
from .spatial import symmetric


def normalised(edges: DataFrame) -> DataFrame:
    """(i, j, s) both ways and with self-loops: exp(-d2 / median d2) over the roots of both degrees, of edges (src, dst, d2) given once each."""
    mid = edges.agg(F.greatest(F.percentile_approx("d2", 0.5, 10000), F.lit(1e-12)).alias("_m"))
    both = symmetric(edges.crossJoin(F.broadcast(mid)).select("src", "dst", F.exp(-F.col("d2") / F.col("_m")).alias("w")))
    loops = both.select(F.col("src").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    whole = cut(both.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w").unionByName(loops), "affinity")
    degree = whole.groupBy("i").agg(F.sum("w").alias("d"))
    met = whole.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    return met.select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("s"))


def read_out(neighbours: DataFrame) -> DataFrame:
    """(i, j, s): inverse-distance weights of measurements (src) over their nearest nodes (dst, d2), summing to one."""
    w = neighbours.select(F.col("src").alias("i"), F.col("dst").alias("j"), (1 / (F.sqrt("d2") + 1e-8)).alias("w"))
    total = w.groupBy("i").agg(F.sum("w").alias("t"))
    return w.join(total, "i").select("i", "j", (F.col("w") / F.col("t")).alias("s"))


class TrainedConvolution:
    """fit() keeps the mean squared error plus penalty of every round in `losses`. Nodes without an edge give and receive nothing."""

    def __init__(self, hidden: int = 8, rounds: int = 20, rate: float = 0.1, penalty: float = 1e-3, seed: int = 0):
        self.hidden, self.rounds, self.rate, self.penalty, self.seed = hidden, rounds, rate, penalty, seed

    def prepare(self, nodes: DataFrame, node: str, features: list[str], edges: DataFrame, neighbours: DataFrame) -> TrainedConvolution:
        """nodes with features; edges (src, dst, d2) among them; neighbours (src, dst, d2) of all measurements that will be trained on or predicted."""
        s = cut(normalised(edges), "normalised")
        x = nodes.select(F.col(node).alias("j"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
        self.width = len(features)
        sums = [F.sum(F.col("s") * F.col(f"x{k}")).alias(f"p{k}") for k in range(self.width)]
        self.smooth = cut(s.join(x, "j").groupBy(F.col("i").alias("node")).agg(*sums), "smoothed")
        reach = read_out(neighbours).withColumnsRenamed({"j": "m", "s": "r"}).join(s.withColumnRenamed("i", "m"), "m")
        self.reach = cut(reach.groupBy("i", "j").agg(F.sum(F.col("r") * F.col("s")).alias("m")), "reach")
        scale = self.smooth.agg(*[F.coalesce(F.stddev_pop(f"p{k}"), F.lit(1.0)) for k in range(self.width)]).first()
        rng = np.random.default_rng(self.seed)
        self.weights = rng.normal(size=(self.width, self.hidden)) / np.maximum(np.array([v or 1.0 for v in scale], dtype=float), 1e-9)[:, None]
        self.shift = 0.5 * rng.normal(size=self.hidden)
        return self

    def _hidden(self) -> DataFrame:
        def unit(k: int) -> str:
            return "greatest(0D, " + " + ".join([f"{float(self.shift[k])!r}D", *[f"p{f} * {float(self.weights[f, k])!r}D" for f in range(self.width)]]) + ")"

        return self.smooth.selectExpr("node", *[f"{unit(k)} AS h{k}" for k in range(self.hidden)])

    def _forward(self, reach: DataFrame, hidden: DataFrame) -> DataFrame:
        return reach.join(hidden, F.expr("j = node")).groupBy("i").agg(*[F.expr(f"sum(m * h{k}) AS z{k}") for k in range(self.hidden)])

    def evaluate(self, train: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, its gradient by W, by c) at the present W and c, with V and b at their best; train is (i, y)."""
        h = cut(self._hidden(), "hidden")
        z = cut(self._forward(self.reach.join(train.select("i"), "i", "left_semi"), h).join(train, "i").withColumn("one", F.lit(1.0)), "forward")
        names = [*[f"z{k}" for k in range(self.hidden)], "one"]
        m = _moments(z, [*names, "y"], [*names, "y"])
        n, a, b = max(m[-2, -2], 1.0), m[:-1, :-1], m[:-1, -1]
        ridge = self.penalty * n * np.diag([1.0] * self.hidden + [1e-12])
        out = np.linalg.solve(a + ridge, b)
        self.out, self.base = out[:-1], float(out[-1])
        loss = float((m[-1, -1] - 2 * out @ b + out @ a @ out) / n + self.penalty * self.out @ self.out)
        gap = " + ".join([f"{self.base!r}D - y", *[f"z{k} * {float(self.out[k])!r}D" for k in range(self.hidden)]])
        back = self.reach.join(z.selectExpr("i", f"{gap} AS g"), "i").groupBy(F.col("j").alias("node")).agg(F.expr("sum(m * g) AS g"))
        met = back.join(h, "node").join(self.smooth, "node")
        sums = [F.expr(f"sum(CASE WHEN h{k} > 0 THEN g * {x} ELSE 0D END)") for k in range(self.hidden) for x in ["1D", *[f"p{f}" for f in range(self.width)]]]
        raw = np.array([v or 0.0 for v in met.agg(*sums).first()], dtype=float).reshape(self.hidden, self.width + 1)
        grad = 2 / n * raw * self.out[:, None]
        release(h)
        release(z)
        return loss, grad[:, 1:].T, grad[:, 0]

    def fit(self, train: DataFrame, key: str, target: str) -> TrainedConvolution:
        """train: measurements (key, target), among those that prepare() was given neighbours of; null targets teach nothing."""
        rows = cut(train.select(F.col(key).alias("i"), F.col(target).cast("double").alias("y")).where("y is not null and not isnan(y)"), "targets")
        self.losses, best = [], None
        size = np.zeros(self.hidden * (self.width + 1))
        speed = np.zeros_like(size)
        for step in range(1, self.rounds + 1):
            loss, by_w, by_c = self.evaluate(rows)
            self.losses.append(loss)
            if best is None or loss < best[0]:
                best = loss, self.weights.copy(), self.shift.copy(), self.out.copy(), self.base
            g = np.concatenate([by_w.ravel(), by_c])
            speed = 0.8 * speed + 0.2 * g
            size = 0.95 * size + 0.05 * g * g
            move = self.rate * (speed / (1 - 0.8**step)) / (np.sqrt(size / (1 - 0.95**step)) + 1e-12)
            self.weights = self.weights - move[: self.weights.size].reshape(self.weights.shape)
            self.shift = self.shift - move[self.weights.size :]
        _, self.weights, self.shift, self.out, self.base = best
        return self

    def predict(self) -> DataFrame:
        """(i, prediction) of every measurement that prepare() was given neighbours of."""
        z = self._forward(self.reach, self._hidden())
        return z.selectExpr("i", " + ".join([f"{self.base!r}D", *[f"z{k} * {float(self.out[k])!r}D" for k in range(self.hidden)]]) + " AS prediction")
