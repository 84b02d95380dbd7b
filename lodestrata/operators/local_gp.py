"""Gaussian processes through nearest neighbours: every row is conditioned on at most k others, so no kernel matrix is larger than k x k.

Fitting conditions each row on near rows that come before it in a fixed random order, which makes the product of the conditionals a
likelihood; prediction conditions a new row on the training rows nearest to it. The small Cholesky solves of a batch are done at once, for
all channels together. With all rows as neighbours both are the exact process.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import portable_hash
from ..plans.shared import cut
from .knn_tree import tree_blocks, tree_knn

#: A level of the order holds so many times the rows before it; the first one at least so many rows.
GROWTH, FIRST = 8, 64
#: Rows whose matrices are solved at a time.
STEP = 512


def order_of(seed: int = 0):
    """A column that orders rows (id) at random but repeatably, in [0, 1)."""
    return F.conv(F.substring(portable_hash(seed, "id"), 1, 12), 16, 10).cast("double") / float(16**12)


def preceding(points: DataFrame, key: str, coords: list[str], k: int, seed: int = 0) -> DataFrame:
    """(src, dst, rank): up to k near rows that come before each row in the order of (order_of, key); with k of n - 1 or more, all of them.

    Rows are taken level by level, each GROWTH times as many as all before it, and a level's neighbours are sought among it and those: so even
    early rows, whose neighbours lie far off, find theirs in a tree that holds few others.
    """
    rows = cut(points.select(F.col(key).cast("long").alias("id"), *coords).withColumn("o", order_of(seed)), "ordered")
    n = rows.count()
    first = max(FIRST, 4 * k)
    shares = [first / max(n, 1)]
    while shares[-1] < 1.0:
        shares.append(shares[-1] * GROWTH)
    out, below = None, -1.0
    for level, share in enumerate(shares):
        here = rows.where((F.col("o") >= below) & (F.col("o") < share))
        refs, below = rows.where(F.col("o") < share), share
        near = tree_knn(here, refs, "id", coords, min(n, 4 * first) if level == 0 else 3 * k, same=True)
        out = near if out is None else out.unionByName(near)
    a = rows.select(F.col("id").alias("src"), F.col("o").alias("oa"))
    b = rows.select(F.col("id").alias("dst"), F.col("o").alias("ob"))
    met = out.select("src", "dst", "d2").join(a, "src").join(b, "dst").where((F.col("ob") < F.col("oa")) | ((F.col("ob") == F.col("oa")) & (F.col("dst") < F.col("src"))))
    place = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("src", "dst", "rank")


def along_graph(train: DataFrame, key: str, edges: DataFrame, k: int, seed: int = 0, coords: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours by shortest paths over edges (src, dst, d2) of the training rows instead of straight lines: (src, dst, rank) before each row in the
    order of order_of, for fit(); and the k nearest of each row, itself first, for rows that snap to it. Coordinates, where edges join near rows, only
    say which rows are searched together."""
    from .graph import blocks_for, geodesic_knn

    order = cut(train.select(F.col(key).cast("long").alias("id")).withColumn("place", order_of(seed)).select(F.col("id").alias("node"), "place"), "order")
    blocks = cut(tree_blocks(train, key, coords, blocks_for(train.sparkSession, order.count())), "blocks") if coords else None
    before = geodesic_knn(edges, k, order, blocks).select(F.col("source").alias("src"), F.col("node").alias("dst"), "rank")
    near = geodesic_knn(edges, k - 1, blocks=blocks).select(F.col("source").alias("src"), F.col("node").alias("dst"), (F.col("rank") + 1).alias("rank"))
    own = order.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("rank"))
    return before, near.unionByName(own)


def snapped(new: DataFrame, train: DataFrame, key: str, coords: list[str], near: DataFrame) -> DataFrame:
    """(src, dst, rank): new rows with the neighbours of the training row they lie nearest to."""
    at = tree_knn(new, train, key, coords, 1).select(F.col("src").alias("_new"), F.col("dst").alias("_at"))
    return at.join(near, F.col("_at") == F.col("src")).select(F.col("_new").alias("src"), "dst", "rank")


def _gathered(rows: DataFrame, neighbours: DataFrame, values: DataFrame, key: str, coords: list[str], channels: list[str]) -> DataFrame:
    """id, own coordinates and channels where rows have them, and the neighbours' as two flat arrays, nearest first."""
    v = values.select(F.col(key).alias("dst"), F.array(*[F.col(c).cast("double") for c in coords]).alias("nx"), F.array(*[F.col(c).cast("double") for c in channels]).alias("ny"))
    lists = neighbours.join(v, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "nx", "ny"))).alias("near"))
    flat = lambda name: F.flatten(F.transform("near", lambda s: s[name]))
    own = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coords)] + [F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(channels) if c in rows.columns]
    out = rows.select(F.col(key).cast("long").alias("id"), *own).join(lists, F.col("id") == F.col("src"), "left")
    empty = F.array().cast("array<double>")
    return out.select("id", *[c for c in out.columns if c[0] in "xy"], F.coalesce(flat("nx"), empty).alias("nx"), F.coalesce(flat("ny"), empty).alias("ny"))


def matern(d: np.ndarray, nu: float) -> np.ndarray:
    """Matern correlation at scaled distances; nu is 0.5, 1.5 or 2.5."""
    if nu == 0.5:
        return np.exp(-d)
    s = np.sqrt(2 * nu) * d
    return (1 + s) * np.exp(-s) if nu == 1.5 else (1 + s + s * s / 3) * np.exp(-s)


class _Batch:
    """Neighbour sets of a batch as padded arrays, with the distances among them and to their row."""

    def __init__(self, batch: pa.RecordBatch, dims: int, channels: int):
        n, offsets = batch.num_rows, batch.column("nx").offsets.to_numpy()
        size = np.diff(offsets) // dims
        k = max(1, int(size.max()) if n else 1)
        self.there = np.arange(k)[None, :] < size[:, None]
        self.x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(dims)])
        nx, ny = np.zeros((n, k, dims)), np.zeros((n, k, channels))
        values = batch.column("nx").values.to_numpy()[offsets[0] : offsets[-1]]
        nx[self.there] = values.reshape(-1, dims)
        o = batch.column("ny").offsets.to_numpy()
        ny[self.there] = batch.column("ny").values.to_numpy()[o[0] : o[-1]].reshape(-1, channels)
        self.ny, self.k = ny, k
        self.among = np.sqrt(((nx[:, :, None, :] - nx[:, None, :, :]) ** 2).sum(axis=3))
        self.to = np.sqrt(((nx - self.x[:, None, :]) ** 2).sum(axis=2))
        self.apart = ~(self.there[:, :, None] & self.there[:, None, :])

    def condition(self, scale: float, noise: float, nu: float) -> tuple[np.ndarray, np.ndarray]:
        """(weights, variance) of each row given its neighbours, for a unit output scale; variance includes the noise."""
        gram = matern(self.among / scale, nu)
        gram[self.apart] = 0.0
        at = np.arange(self.k)
        gram[:, at, at] = 1.0 + noise
        cross = np.where(self.there, matern(self.to / scale, nu), 0.0)
        low = np.linalg.cholesky(gram)
        half = np.linalg.solve(low, cross[:, :, None])
        weights = np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0]
        return weights, np.maximum(1.0 + noise - (half[:, :, 0] ** 2).sum(axis=1), 1e-12)


def fit(train: DataFrame, neighbours: DataFrame, key: str, coords: list[str], channels: list[str], scales: list[float], noises: list[float], nu: float = 2.5) -> list[dict]:
    """channel, mean, scale, noise, variance, log_likelihood of each channel: the pair of scale and noise (relative to the variance) with
    the highest likelihood given the neighbours (src, dst, rank; each before its row). The variance that maximises it follows in closed form.

    A pass computes all pairs for all channels; only their sums reach the driver. Rows with a null value or coordinate must be left out before. Without rows there is no answer: an empty list.
    """
    sums = train.agg(F.count("*"), *[F.avg(c) for c in channels]).first()
    n, means = sums[0], np.array([float(m or 0.0) for m in sums[1:]])
    if not n:
        return []
    grid, dims = list(product(scales, noises)), len(coords)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, logs = np.zeros((len(grid), len(channels))), np.zeros(len(grid))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                b = _Batch(part, dims, len(channels))
                y = np.column_stack([part.column(f"y{i}").to_numpy() for i in range(len(channels))]) - means
                ny = np.where(b.there[:, :, None], b.ny - means, 0.0)
                for g, (scale, noise) in enumerate(grid):
                    w, v = b.condition(scale, noise, nu)
                    gap = y - np.einsum("bk,bkc->bc", w, ny)
                    square[g] += (gap * gap / v[:, None]).sum(axis=0)
                    logs[g] += np.log(v).sum()
        g, c = np.indices(square.shape)
        yield pa.RecordBatch.from_pydict({"g": g.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "square": square.ravel(), "logs": np.repeat(logs, len(channels))})

    made = _gathered(train, neighbours, train, key, coords, channels).mapInArrow(of, "g int, c int, square double, logs double")
    best: dict[int, dict] = {}
    for r in made.groupBy("g", "c").agg(F.sum("square").alias("square"), F.sum("logs").alias("logs")).collect():
        variance = max(r["square"] / n, 1e-300)
        score = -0.5 * (n * np.log(variance) + r["logs"] + n + n * np.log(2 * np.pi))
        one = {"channel": channels[r["c"]], "mean": float(means[r["c"]]), "scale": grid[r["g"]][0], "noise": grid[r["g"]][1], "variance": float(variance), "log_likelihood": float(score)}
        old = best.get(r["c"])
        if old is None or (score, -r["g"]) > (old["log_likelihood"], -grid.index((old["scale"], old["noise"]))):
            best[r["c"]] = one
    return [best[c] for c in sorted(best)]


def predict(new: DataFrame, neighbours: DataFrame, train: DataFrame, key: str, coords: list[str], fitted: list[dict], nu: float = 2.5) -> DataFrame:
    """(key, channel, mean, variance) of every new row and fitted channel, given its nearest training rows (src, dst, rank). Variance is that
    of a new measurement. A row without neighbours gets the channel's mean and full variance."""
    channels, dims = [f["channel"] for f in fitted], len(coords)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                b, ids = _Batch(part, dims, len(channels)), part.column("id").to_numpy()
                known: dict = {}
                for c, f in enumerate(fitted):
                    pair = f["scale"], f["noise"]
                    if pair not in known:
                        known[pair] = b.condition(*pair, nu)
                    w, v = known[pair]
                    ny = np.where(b.there, b.ny[:, :, c] - f["mean"], 0.0)
                    yield pa.RecordBatch.from_pydict({"id": ids, "channel": [f["channel"]] * len(ids), "mean": (w * ny).sum(axis=1) + f["mean"], "variance": v * f["variance"]})

    made = _gathered(new.select(key, *coords), neighbours, train, key, coords, channels).mapInArrow(of, "id long, channel string, mean double, variance double")
    return made.withColumnRenamed("id", key)
