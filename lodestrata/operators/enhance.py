"""Patterns of section images brought out: envelopes of the analytic signal in two dimensions, and anti-leakage Fourier smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _analytic(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(image, axis=axis) * (gain[:, None] if axis == 0 else gain[None, :]), axis=axis)


def envelope_2d(image: np.ndarray) -> np.ndarray:
    """Size of the analytic signals along both axes together."""
    return np.abs(_analytic(image, 0) + _analytic(image, 1) - image)


def anti_leakage(image: np.ndarray, share: float = 0.1, most: int = 64, stop: float = 0.05) -> np.ndarray:
    """The image from its strongest wavenumbers, taken one by one until what is left holds less than `stop` of the energy, or `most` of them,
    or a share of all, are taken. Taking one leaves the others as they are, so the order is that of their sizes (ties by place)."""
    spectrum = np.fft.fft2(image)
    size = np.abs(spectrum).ravel()
    order = np.argsort(-size, kind="stable")
    energy = size[order] ** 2
    left = energy.sum() - np.cumsum(energy)
    enough = np.flatnonzero(left / (energy.sum() + 1e-12) < stop)
    count = min(most, max(1, int(share * size.size)), int(enough[0]) + 1 if len(enough) else size.size)
    kept = np.zeros(size.size, dtype=complex)
    kept[order[:count]] = spectrum.ravel()[order[:count]]
    return np.real(np.fft.ifft2(kept.reshape(image.shape)))


MODES = {"envelope": envelope_2d, "anti-leakage": anti_leakage}


def enhance(points: DataFrame, section: str, u: str, v: str, channels: list[str], grid: int, mode: str, least: int = 4) -> DataFrame:
    """points with every channel's value in the enhanced image of its section: rows are averaged onto a grid over the section's extent, the
    image goes through MODES[mode], and each row takes its cell's value. Empty cells are zero. Sections of fewer rows than `least`, and rows
    without a place, keep their values. All sections are worked at once; a task holds one section's image, at most grid x grid cells.
    """
    names = ["_s", "_i", "_j", "_lu", "_hu", "_lv", "_hv", "_n"]
    assert not set(names) & set(points.columns)
    here = F.col(u).isNotNull() & F.col(v).isNotNull() & ~F.isnan(F.col(u).cast("double")) & ~F.isnan(F.col(v).cast("double"))
    spans = points.where(here).groupBy(F.col(section).alias("_s")).agg(F.min(u).alias("_lu"), F.max(u).alias("_hu"), F.min(v).alias("_lv"), F.max(v).alias("_hv"), F.count("*").alias("_n"))
    place = lambda c, lo, hi: F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * (grid - 1)).cast("int")
    binned = points.join(spans, F.col(section).eqNullSafe(F.col("_s")), "left").withColumns({"_i": place(u, "_lu", "_hu"), "_j": place(v, "_lv", "_hv")})
    cells = binned.where((F.col("_n") >= least) & F.col("_i").isNotNull() & F.col("_j").isNotNull())
    cells = cells.groupBy(F.col(section).alias("_s"), "_i", "_j").agg(*[F.avg(F.col(c).cast("double")).alias(f"_c{k}") for k, c in enumerate(channels)])

    def of(rows: pa.Table) -> pa.Table:
        i, j = rows.column("_i").to_numpy(), rows.column("_j").to_numpy()
        out = {"_s": rows.column("_s"), "_i": rows.column("_i"), "_j": rows.column("_j")}
        for k in range(len(channels)):
            image = np.zeros((grid, grid))
            image[i, j] = np.nan_to_num(rows.column(f"_c{k}").to_numpy().astype(float), nan=0.0)
            out[f"_e{k}"] = MODES[mode](image)[i, j]
        return pa.table(out)

    kind = cells.schema["_s"].dataType.simpleString()
    made = cells.groupBy("_s").applyInArrow(of, f"_s {kind}, _i int, _j int, {', '.join(f'_e{k} double' for k in range(len(channels)))}").withColumnsRenamed({"_s": "_t", "_i": "_ti", "_j": "_tj"})
    met = binned.join(made, F.col(section).eqNullSafe(F.col("_t")) & (F.col("_i") == F.col("_ti")) & (F.col("_j") == F.col("_tj")), "left")
    new = {c: F.coalesce(F.col(f"_e{k}"), F.col(c).cast("double")).alias(c) for k, c in enumerate(channels)}
    return met.select(*[new.get(c, F.col(c)) for c in points.columns])
