"""Histograms and ranks that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut
from .stats import uniform_bin


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """keys, bin, n over bins of equal width shared by all keys."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = uniform_bin(value, F.col("_lo"), F.col("_hi"), bins)
    return df.crossJoin(F.broadcast(span)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_density(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """df with density: the number of rows in the row's cell of a bins x bins grid. Counts (bounded by the grid) are broadcast back."""
    span = df.agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    binned = df.crossJoin(F.broadcast(span)).withColumns({"_x": uniform_bin(a, F.col("_a0"), F.col("_a1"), bins), "_y": uniform_bin(b, F.col("_b0"), F.col("_b1"), bins)})
    counts = binned.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("density"))
    return binned.join(F.broadcast(counts), ["_x", "_y"]).select(*df.columns, "density")


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank", parts: int | None = None, running: dict[str, str] | None = None) -> DataFrame:
    """df with its rank from 0 in a total order, and running sums (new column: what it sums) up to each row: rows are range-partitioned and
    sorted, scanned inside their range, and shifted by the counts and sums of the ranges before, of which there are as many as
    partitions. No task sees more than its range."""
    # written once: ranges come from a sample, so a second evaluation could draw other ones; without a number, small ranges are joined
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged = cut(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = {"_local": F.lit(1), **{f"_sum_{n}": F.col(w) for n, w in (running or {}).items()}}
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({n: F.sum(w).over(inside) for n, w in sums.items()})
    held = ranged.groupBy("_part").agg(*[F.sum(w).alias(f"{n}_before") for n, w in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_part", *[F.coalesce(F.sum(f"{n}_before").over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums])
    out = local.join(F.broadcast(before), "_part")
    found = {name: (F.col("_local") - 1 + F.col("_local_before")).cast("bigint")}
    found |= {n: F.col(f"_sum_{n}") + F.col(f"_sum_{n}_before") for n in running or {}}
    return out.withColumns(found).select(*df.columns, *found)


def ntile_bins(df: DataFrame, value: str, tie: str, bins: int) -> DataFrame:
    """df with bin 1..bins of equal counts in the order of (value, tie), as ntile gives them."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(df, [value, tie], "_r").crossJoin(F.broadcast(n))
    size, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    head = extra * (size + 1)
    b = F.when(F.col("_r") < head, F.floor(F.col("_r") / (size + 1))).otherwise(extra + F.floor((F.col("_r") - head) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("bin", (b + 1).cast("int")).drop("_r", "_n")


def picks_along(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced along an order, with their ranks."""
    ranked = global_rank(df, order)
    top = df.agg((F.count(F.lit(1)) - 1).alias("_top"))
    want = df.sparkSession.range(n).crossJoin(F.broadcast(top)).select(F.floor(F.col("id") * F.col("_top") / float(n - 1)).alias("rank")).distinct()
    return ranked.join(F.broadcast(want), "rank")
