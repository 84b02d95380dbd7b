"""Learners with one contract: fit on a table, predict a column. Closed forms and MLlib."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}


def register(name: str):
    """Adds an estimator class to the registry under a name."""

    def put(cls):
        REGISTRY[name] = cls
        return cls

    return put


@register("mean")
class Mean:
    """Predicts the training mean."""

    def fit(self, train: DataFrame, features: list[str], target: str) -> Mean:
        self.stats = train.agg(F.avg(target).alias("_mean"))
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.crossJoin(F.broadcast(self.stats)).withColumn(name, F.col("_mean")).drop("_mean")


def normal_equations(df: DataFrame, features: list[str], target: str):
    """Moments of [1, features] and target by one aggregation; as many numbers as features squared come to the driver."""
    import numpy as np

    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    k = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)])


@register("ridge")
class Ridge:
    """Linear in the features with an unpenalised intercept, from the normal equations."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, train: DataFrame, features: list[str], target: str) -> Ridge:
        import numpy as np

        a, b = normal_equations(train, features, target)
        p = np.eye(len(a)) * self.penalty
        p[0, 0] = 0
        self.features, self.weights = features, np.linalg.lstsq(a + p, b, rcond=None)[0].tolist()
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], self.features, strict=True):
            out = out + w * F.col(c).cast("double")
        return df.withColumn(name, out)


@register("boosting")
class Boosting:
    """Gradient-boosted trees of MLlib; a hashed part of the rows stops the training early."""

    def __init__(self, rounds: int = 20, depth: int = 4, share: float = 0.1, seed: int = 1):
        self.rounds, self.depth, self.share, self.seed = rounds, depth, share, seed

    def fit(self, train: DataFrame, features: list[str], target: str, key: str | None = None) -> Boosting:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        self.assembler = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
        from ..functions.exprs import portable_uniform

        data = self.assembler.transform(train).withColumn("_val", portable_uniform(self.seed, *([key] if key else features)) < self.share)
        self.model = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=self.rounds, maxDepth=self.depth, seed=self.seed, validationIndicatorCol="_val").fit(data)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = self.model.setPredictionCol(name).transform(self.assembler.transform(df))
        return out.drop("_x")


def shepard(neighbours: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(src, value): mean of the neighbours' values weighted by inverse distance."""
    w = 1 / (F.sqrt("d2") + 1e-8)
    met = neighbours.join(values, "dst")
    return met.groupBy("src").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 1, name: str = "cluster"):
    """(model, df with the cluster) by MLlib."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = KMeans(featuresCol="_x", predictionCol=name, k=k, seed=seed).fit(data)
    return model, model.transform(data).drop("_x")


def centres_to_points(df: DataFrame, key: str, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """The real points nearest to k-means centres, each once. The centres are k rows."""
    model, _ = kmeans(df, features, k, seed)
    centres = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "centre int, " + ", ".join(f"c{j} double" for j in range(len(features))))
    met = df.crossJoin(F.broadcast(centres))
    d2 = sum(((F.col(f) - F.col(f"c{j}")) * (F.col(f) - F.col(f"c{j}")) for j, f in enumerate(features)), F.lit(0.0))
    return met.groupBy("centre").agg(F.min(F.struct(d2.alias("d2"), F.col(key).alias("k"))).alias("b")).select(F.col("b.k").alias(key)).distinct()


def mirrored_kmeans(df: DataFrame, key: str, features: list[str], axis: str, k: int, seed: int = 1) -> DataFrame:
    """Points of k-means on one half along an axis (up to its median), and their mirror images: (features)."""
    mid = df.agg(F.median(axis)).first()[0]
    half = centres_to_points(df.where(F.col(axis) <= mid), key, features, k, seed)
    own = df.join(half, key, "left_semi").select(*features)
    return own.unionByName(own.withColumn(axis, 2 * mid - F.col(axis))).distinct()


def soft_membership(distances: DataFrame, node: str, parcel: str, d2: str, top: int) -> DataFrame:
    """(node, parcel, w): softmax of -d2 over an adaptive temperature (each node's mean d2 to its `top` parcels), weights of the top ones sum to 1."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(node).orderBy(d2, parcel))
    near = distances.withColumn("_n", place).where(F.col("_n") <= top)
    w = Window.partitionBy(node)
    e = F.exp(-F.col(d2) / F.greatest(F.avg(d2).over(w), F.lit(1e-12)))
    return near.withColumn("_e", e).withColumn("w", F.col("_e") / F.sum("_e").over(w)).select(node, parcel, "w")


@register("mlp")
class Perceptron:
    """One hidden layer on standardised features, fitted by full-batch Adam to a bounded, hashed sample; predicts in Arrow batches."""

    def __init__(self, hidden: int = 32, rounds: int = 400, sample: int = 20000, seed: int = 1, patience: int = 50):
        self.hidden, self.rounds, self.sample, self.seed, self.patience = hidden, rounds, sample, seed, patience

    def fit(self, train: DataFrame, features: list[str], target: str, key: str | None = None) -> Perceptron:
        import numpy as np

        from ..functions.exprs import portable_hash

        names = [key] if key else features
        rows = train.orderBy(portable_hash(self.seed, *names), *names).limit(self.sample).select(*[F.col(c).cast("double") for c in [*features, target]]).collect()
        data = np.array(rows, dtype=float)
        x, y = data[:, :-1], data[:, -1]
        self.features = features
        self.mean, self.scale, self.shift, self.size = x.mean(0), x.std(0) + 1e-9, y.mean(), y.std() + 1e-9
        x, y = (x - self.mean) / self.scale, (y - self.shift) / self.size
        held = np.arange(len(x)) % 10 == 9
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(size=(x.shape[1], self.hidden)) / x.shape[1] ** 0.5, np.zeros(self.hidden), rng.normal(size=self.hidden) / self.hidden**0.5, np.zeros(1)]
        m, v, best, left = [0 * p for p in w], [0 * p for p in w], (np.inf, w), self.patience
        for k in range(1, self.rounds + 1):
            a = np.tanh(x[~held] @ w[0] + w[1])
            e = (a @ w[2] + w[3] - y[~held]) / max(1, (~held).sum())
            back = np.outer(e, w[2]) * (1 - a * a)
            grads = [x[~held].T @ back, back.sum(0), a.T @ e, np.array([e.sum()])]
            for j, g in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                w[j] = w[j] - 0.02 * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
            loss = float(((np.tanh(x[held] @ w[0] + w[1]) @ w[2] + w[3] - y[held]) ** 2).mean()) if held.any() else float((e * e).sum())
            if loss < best[0]:  # the best snapshot is what stays
                best, left = (loss, [p.copy() for p in w]), self.patience
            else:
                left -= 1
                if not left:
                    break
        self.weights = best[1]
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        import numpy as np

        w, mean, scale, shift, size, features = self.weights, self.mean, self.scale, self.shift, self.size, self.features

        @F.pandas_udf("double")
        def of(batch: pd.DataFrame) -> pd.Series:
            x = (batch[features].to_numpy(float) - mean) / scale
            return pd.Series((np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]) * size + shift)

        return df.withColumn(name, of(F.struct(*[F.col(c).cast("double").alias(c) for c in features])))


@register("graph_convolution")
class GraphConvolution:
    """Features after steps of the random walk over a graph, then a linear read-out."""

    def __init__(self, parts: dict[str, DataFrame], steps: int = 2, penalty: float = 1e-3):
        self.parts, self.steps, self.ridge = parts, steps, Ridge(penalty)

    def fit(self, train: DataFrame, features: list[str], target: str) -> GraphConvolution:
        """train: (node, features, target); features of all nodes come with predict()'s table, so they are kept from `nodes`."""
        self.features = features
        self.ridge.fit(train, features, target)
        return self

    def smooth(self, nodes: DataFrame, features: list[str]) -> DataFrame:
        from .graph import propagate

        return propagate(self.parts, nodes, features, self.steps)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.ridge.predict(df, name)


def factor_posterior(latent: DataFrame, factors: list[str], outputs: list[str], noise: float, prior: float = 1.0):
    """Posterior mean (factors x outputs) and covariance of the linear decoder of a latent factor model, from sums alone."""
    import numpy as np

    k = len(factors)
    aggs = [F.sum(F.col(factors[i]) * F.col(factors[j])).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.col(f) * F.col(o)).alias(f"b{i}_{n}") for i, f in enumerate(factors) for n, o in enumerate(outputs)]
    row = latent.agg(*aggs).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([[row[f"b{i}_{n}"] or 0.0 for n in range(len(outputs))] for i in range(k)])
    cov = np.linalg.inv(a / noise + np.eye(k) / prior)
    return cov @ b / noise, cov


@register("spectral")
class SpectralRegression:
    """Gaussian-process regression on spectral features: weights of mode k have prior variance density[k].

    The posterior comes from one aggregation of modes x modes moments; mean and variance of a row are expressions. With more than MANY
    modes the moments are matrix products where the rows lie, and so is the prediction, so that no plan grows with their square.
    """

    MANY = 16

    def __init__(self, density: list[float], noise: float):
        self.density, self.noise = density, noise

    def fit(self, train: DataFrame, features: list[str], target: str) -> SpectralRegression:
        import numpy as np

        k, cols = len(features), [F.col(c).cast("double") for c in features]
        if k > self.MANY:
            from .eigen import _moments

            # a null makes no product, as in a sum
            m = _moments(train.select(*[F.coalesce(c, F.lit(0.0)).alias(f"x{i}") for i, c in enumerate([*cols, F.col(target).cast("double")])]), *[[f"x{i}" for i in range(n)] for n in (k, k + 1)])
            return self._solve(features, m[:, :k], m[:, k])
        aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols)]
        row = train.agg(*aggs).first()
        a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        b = np.array([row[f"b{i}"] or 0.0 for i in range(k)])
        return self._solve(features, a, b)

    def _solve(self, features: list[str], a, b) -> SpectralRegression:
        import numpy as np

        self.features = features
        self.covariance = np.linalg.inv(a / self.noise + np.diag(1 / np.array(self.density)))
        self.weights = self.covariance @ b / self.noise
        return self

    def predict(self, df: DataFrame, name: str = "prediction", variance: str | None = None) -> DataFrame:
        cols = [F.col(c).cast("double") for c in self.features]
        if len(cols) > self.MANY:
            return self._predict_many(df, cols, name, variance)
        mean = sum((float(w) * c for w, c in zip(self.weights, cols, strict=True)), F.lit(0.0))
        out = df.withColumn(name, mean)
        if variance:
            terms = [float(self.covariance[i, j]) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))]
            out = out.withColumn(variance, sum(terms, F.lit(self.noise)))
        return out


    def _predict_many(self, df: DataFrame, cols: list, name: str, variance: str | None) -> DataFrame:
        import pandas as pd

        weights, covariance, noise = self.weights, self.covariance, self.noise

        @F.pandas_udf("mean double, variance double")
        def of(batch: pd.DataFrame) -> pd.DataFrame:
            x = batch.to_numpy(dtype=float)
            # a missing feature makes both NaN, which is null in what comes back
            return pd.DataFrame({"mean": x @ weights, "variance": noise + ((x @ covariance) * x).sum(axis=1)})

        made = of(F.struct(*[c.alias(f"x{i}") for i, c in enumerate(cols)]))
        out = df.withColumn("_spectral", made).withColumn(name, F.col("_spectral.mean"))
        return (out.withColumn(variance, F.col("_spectral.variance")) if variance else out).drop("_spectral")


@register("hash_field")
class HashField:
    """A field over space: tables of numbers on hashed grids of several resolutions, read by trilinear weights and summed.

    Fitted by gradient steps over all rows: a step joins the corners of the rows to the table, sums the errors and
    the weights of every entry, and moves each entry by its mean error. The table is bounded by levels x size.
    """

    #: One multiplier for each axis.
    PRIMES = (1, 2654435761, 805459861)

    def __init__(self, resolutions: tuple[int, ...] = (4, 8, 16), size: int = 4096, rounds: int = 8, rate: float = 0.5):
        self.resolutions, self.size, self.rounds, self.rate = resolutions, size, rounds, rate

    def corners(self, df: DataFrame, key: str, coords: list[str]) -> DataFrame:
        """(key, entry, w): eight corners at every resolution."""
        from ..functions.exprs import spatial_hash
        from .spatial import trilinear

        out = None
        for level, res in enumerate(self.resolutions):
            scaled = df.select(key, *[(F.col(c) * res).alias(c) for c in coords])
            at = trilinear(scaled, coords)
            cells = [F.floor(c).cast("long") + F.col(n) for c, n in zip(coords, ("i", "j", "k"), strict=True)]
            part = at.select(key, (F.lit(level * self.size) + spatial_hash(cells, self.PRIMES, self.size)).alias("entry"), "w")
            out = part if out is None else out.unionByName(part)
        return out

    def fit(self, train: DataFrame, key: str, coords: list[str], target: str) -> HashField:
        from ..plans.shared import cut

        at = cut(self.corners(train, key, coords), "corners")
        y = cut(train.select(key, F.col(target).cast("double").alias("_y")), "targets")
        self.key, self.coords = key, coords
        self.table = cut(at.select("entry").distinct().withColumn("v", F.lit(0.0)), "table")
        for _ in range(self.rounds):
            guess = at.join(F.broadcast(self.table), "entry").groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("_p"))
            error = y.join(guess, key).select(key, (F.col("_y") - F.col("_p")).alias("_e"))
            step = at.join(error, key).groupBy("entry").agg((F.sum(F.col("w") * F.col("_e")) / F.sum("w")).alias("_s"))
            moved = F.col("v") + self.rate * F.coalesce("_s", F.lit(0.0))
            self.table = cut(self.table.join(step, "entry", "left").select("entry", moved.alias("v")), "table")
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        guess = self.corners(df, self.key, self.coords).join(F.broadcast(self.table), "entry", "left").groupBy(self.key).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias(name))
        return df.join(guess, self.key)
