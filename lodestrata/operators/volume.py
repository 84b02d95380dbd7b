"""Sparse voxel volumes: rows (z, y, x, value). Surfaces, holes, smoothing and derived features."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import cut
from .graph import border_distance

AXES = ["z", "y", "x"]
_SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def shifted(df: DataFrame, offsets: list[tuple[int, ...]], extra: dict[str, list] | None = None) -> DataFrame:
    """Each row once for every offset, moved by it; extra gives columns with a value for each offset."""
    extra = extra or {}
    items = F.array(*[F.struct(*[F.lit(v).alias(f"o{k}") for k, v in enumerate(o)], *[F.lit(vs[i]).alias(n) for n, vs in extra.items()]) for i, o in enumerate(offsets)])
    out = df.withColumn("_o", F.explode(items))
    moved = out.withColumns({a: F.col(a) + F.col(f"_o.o{k}") for k, a in enumerate(AXES)})
    return moved.withColumns({n: F.col(f"_o.{n}") for n in extra}).drop("_o") if extra else moved.drop("_o")


def rim(nodes: DataFrame) -> DataFrame:
    """Background voxels with a face in common with a node. A node's nearest background voxel is always one of them."""
    own = nodes.select(*AXES)
    return shifted(own, _SIX).distinct().join(own, AXES, "left_anti")


def surface_depth(nodes: DataFrame, key: str, voxel: float = 1.0, cell: float = 2.0) -> DataFrame:
    """(key, depth): Euclidean distance to the nearest background voxel."""
    a = nodes.select(key, F.lit(1).alias("side"), *[F.col(c).cast("double").alias(c) for c in AXES])
    b = rim(nodes).select(F.xxhash64(*AXES).alias(key), F.lit(0).alias("side"), *[F.col(c).cast("double").alias(c) for c in AXES])
    return border_distance(a, cut(b, "rim"), key, "side", AXES, cell).select(key, (F.sqrt("d2") * voxel).alias("depth"))


def fill_holes(nodes: DataFrame) -> DataFrame:
    """(z, y, x) of the nodes and of the background inside them that no face-connected way leads out of.

    The box around the nodes is laid out as rows; components of its background that touch its sides are outside.
    """
    own = nodes.select(*[F.col(a).cast("long").alias(a) for a in AXES])
    box = own.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    span = [F.explode(F.sequence(f"lo_{a}", f"hi_{a}")) for a in AXES]
    # the box is one row: its first axis is dealt out before planes are laid out, so that no task lays out the whole
    grid = box.withColumn(AXES[0], span[0]).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), AXES[0])
    for a, e in zip(AXES[1:], span[1:], strict=True):
        grid = grid.withColumn(a, e)
    free = cut(grid.join(own, AXES, "left_anti"), "free")
    size = {a: F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1 for a in AXES}
    free = free.withColumn("id", ((F.col("z") - F.col("lo_z")) * size["y"] + F.col("y") - F.col("lo_y")) * size["x"] + F.col("x") - F.col("lo_x"))
    ids = cut(free.select("id", *AXES, reduce(lambda p, q: p | q, [(F.col(a) == F.col(f"lo_{a}")) | (F.col(a) == F.col(f"hi_{a}")) for a in AXES]).alias("side")), "ids")
    near = shifted(ids.select(F.col("id").alias("src"), *AXES), _SIX[::2])
    edges = near.join(ids.select(F.col("id").alias("dst"), *AXES), AXES).select("src", "dst")
    roots = components(edges, "src", "dst").withColumnRenamed("node", "id")
    named = ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = named.groupBy("root").agg(F.max("side").alias("open"))
    holes = named.join(open_.where(~F.col("open")), "root", "left_semi").select(*AXES)
    return own.unionByName(holes).distinct()


def gaussian_weights(sigma: float, reach: float = 3.0) -> list[tuple[int, float]]:
    r = max(1, math.ceil(reach * sigma))
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-r, r + 1), w, strict=True)]


def smooth(volume: DataFrame, value: str, sigma: float, reach: float = 3.0) -> DataFrame:
    """(z, y, x, value): Gaussian mean over the voxels that are there, axis after axis, at the places that are there."""
    weights = gaussian_weights(sigma, reach)
    now = volume.select(*AXES, F.col(value).cast("double").alias("_s"), F.lit(1.0).alias("_n"))
    own = volume.select(*AXES)
    for k in range(3):
        offsets = [tuple(d if j == k else 0 for j in range(3)) for d, _ in weights]
        spread = shifted(now, offsets, {"_w": [w for _, w in weights]})
        now = spread.groupBy(*AXES).agg(F.sum(F.col("_s") * F.col("_w")).alias("_s"), F.sum(F.col("_n") * F.col("_w")).alias("_n"))
    return now.join(own, AXES, "left_semi").select(*AXES, (F.col("_s") / F.col("_n")).alias(value))


def local_deviation(volume: DataFrame, value: str, sigma: float) -> DataFrame:
    """(z, y, x, deviation) within a Gaussian neighbourhood."""
    m = smooth(volume, value, sigma).withColumnRenamed(value, "_m")
    q = smooth(volume.withColumn("_v2", F.col(value) * F.col(value)), "_v2", sigma)
    return m.join(q, AXES).select(*AXES, F.sqrt(F.greatest(F.col("_v2") - F.col("_m") * F.col("_m"), F.lit(0.0))).alias("deviation"))


def stencil(volume: DataFrame, value: str, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(z, y, x, v0, v1, ...): the values at the offsets, null where there is no voxel. One join and one aggregation for all of them."""
    back = [tuple(-d for d in o) for o in offsets]
    around = shifted(volume.select(*AXES, F.col(value).alias("_v")), back, {"_k": list(range(len(offsets)))})
    wide = around.groupBy(*AXES).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"v{k}") for k in range(len(offsets))])
    return wide.join(volume.select(*AXES), AXES, "left_semi")


def gradient_size(volume: DataFrame, value: str) -> DataFrame:
    """(z, y, x, gradient): length of the central differences; missing neighbours count as the voxel itself."""
    s = stencil(volume, value, [(0, 0, 0), *_SIX])
    at = lambda k: F.coalesce(f"v{k}", "v0")
    g = [(at(2 * a + 1) - at(2 * a + 2)) / 2 for a in range(3)]
    return s.select(*AXES, F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2]).alias("gradient"))


def hessian_eigenvalues(volume: DataFrame, value: str) -> DataFrame:
    """(z, y, x, e0, e1, e2), ascending, of the second differences."""
    offsets = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= 2]
    at = {o: k for k, o in enumerate(offsets)}
    s = stencil(volume, value, offsets)
    c = f"v{at[0, 0, 0]}"
    v = lambda o: F.coalesce(f"v{at[o]}", c)

    def unit(*axes: tuple[int, int]) -> tuple[int, int, int]:
        o = [0, 0, 0]
        for a, d in axes:
            o[a] += d
        return tuple(o)

    h: dict[str, Column] = {}
    for a in range(3):
        h[f"h{a}{a}"] = v(unit((a, 1))) - 2 * F.col(c) + v(unit((a, -1)))
        for b in range(a + 1, 3):
            h[f"h{a}{b}"] = (v(unit((a, 1), (b, 1))) - v(unit((a, 1), (b, -1))) - v(unit((a, -1), (b, 1))) + v(unit((a, -1), (b, -1)))) / 4
    names = list(h)

    @F.pandas_udf("array<double>")
    def eig(batch: pd.DataFrame) -> pd.Series:
        m = np.zeros((len(batch), 3, 3))
        for n in names:
            a, b = int(n[1]), int(n[2])
            m[:, a, b] = m[:, b, a] = batch[n].to_numpy(float)
        return pd.Series(list(np.linalg.eigvalsh(m))) if len(batch) else pd.Series([], dtype=object)

    out = s.select(*AXES, *[e.alias(n) for n, e in h.items()]).withColumn("_e", eig(F.struct(*names)))
    return out.select(*AXES, *[F.col("_e")[k].alias(f"e{k}") for k in range(3)])
