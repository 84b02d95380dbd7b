"""Scaling with statistics of a training part, coordinates and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ZScore:
    """Mean and deviation per channel: one row, so it is broadcast."""

    stats: DataFrame
    channels: list[str]
    eps: float

    @classmethod
    def fit(cls, train: DataFrame, channels: list[str], ddof: int = 1, eps: float = 0.0) -> ZScore:
        sd = F.stddev_samp if ddof else F.stddev_pop
        aggs = [f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in channels for k, f in (("m", F.avg), ("s", sd))]
        return cls(train.agg(*aggs), channels, eps)

    def _apply(self, df: DataFrame, f) -> DataFrame:
        met = df.crossJoin(F.broadcast(self.stats))
        out = met.withColumns({c: f(F.col(c).cast("double"), F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}") + self.eps, F.lit(0.0))) for c in self.channels})
        return out.select(*df.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda v, m, s: (v - m) / s)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda v, m, s: v * s + m)


def range_stats(train: DataFrame, channels: list[str]) -> DataFrame:
    return train.agg(*[F.min(c).cast("double").alias(f"_a_{c}") for c in channels], *[(F.max(c) - F.min(c)).cast("double").alias(f"_w_{c}") for c in channels])


def scale_range(df: DataFrame, stats: DataFrame, channels: list[str]) -> DataFrame:
    """(x - min) / range by the statistics of another table; a constant gives null."""
    met = df.crossJoin(F.broadcast(stats))
    return met.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_w_{c}"), F.lit(0.0)) for c in channels}).select(*df.columns)


def standardise_coordinates(df: DataFrame, coords: list[str]) -> DataFrame:
    """Each axis minus its mean, all over one deviation: that of all coordinates pooled. _scale holds the deviation."""
    n, k = F.count(F.lit(1)).cast("double"), len(coords)
    total = sum((F.sum(c) for c in coords[1:]), F.sum(coords[0]))
    grand = total / (n * k)
    # pooled variance: mean of the axes' variances plus the spread of their means
    within = sum((F.var_pop(c) for c in coords[1:]), F.var_pop(coords[0])) / k
    between = sum(((F.avg(c) - grand) * (F.avg(c) - grand) for c in coords), F.lit(0.0)) / k
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in coords], F.sqrt(within + between).alias("_scale"))
    met = df.crossJoin(F.broadcast(stats))
    return met.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col("_scale"), F.lit(0.0)) for c in coords}).select(*df.columns, "_scale")


def compact_labels(df: DataFrame, label: str, name: str) -> DataFrame:
    """Labels as 0, 1, 2 ... in their order. Ranks are worked out on the distinct labels and joined back."""
    from .bins import global_rank

    return df.join(global_rank(df.select(label).distinct(), [label], name).withColumn(name, F.col(name).cast("int")), label)
