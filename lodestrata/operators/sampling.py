"""Samples, folds and resampling that every engine repeats: all draws come from md5 of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import erfc, portable_hash, portable_uniform, ratio
from .metrics import average_ranks

#: Cumulative probabilities of a Poisson number with mean 1, up to 3; the rest counts as 4.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184)


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement: those whose hashes come first (a top-n, never a full sort)."""
    return df.orderBy(portable_hash(seed, *key), *key).limit(n)


def first_per_group(df: DataFrame, groups: list[str], n, order: list, *key: str, parts: int = 16) -> DataFrame:
    """The first n rows (a number or a column) of each group in an order. Rows are thinned in `parts` parts of every group first, so that
    no task has to order a whole group."""
    n = F.lit(n) if isinstance(n, int) else n
    thin = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    few = df.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts))).withColumn("_n", thin).where(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_part")


def sample_per_group(df: DataFrame, groups: list[str], n: int, seed: int, *key: str) -> DataFrame:
    """At most n rows of each group, by hash."""
    return first_per_group(df, groups, n, [portable_hash(seed, *key), *key], *key)


def group_folds(df: DataFrame, group: list[str], folds: int, seed: int) -> DataFrame:
    """(group, fold): groups dealt to folds in hash order, so that folds differ by one group at most."""
    from .bins import global_rank

    found = df.select(*group).distinct().withColumn("_hash", portable_hash(seed, *group))
    return global_rank(found, ["_hash", *group], "fold").withColumn("fold", (F.col("fold") % folds).cast("int")).drop("_hash")


def split(df: DataFrame, share: float, seed: int, *key: str) -> DataFrame:
    """is_val: whether the row's hash falls below the share."""
    return df.withColumn("is_val", portable_uniform(seed, *key) < share)


def poisson_weight(u: Column) -> Column:
    out = None
    for k, edge in enumerate(POISSON):
        out = F.when(u < edge, k) if out is None else out.when(u < edge, k)
    return out.otherwise(len(POISSON))


def bootstrap_mean(df: DataFrame, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """n, mean, low, high (2.5 and 97.5 %) of the mean over `draws` resamples of units, with Poisson weights.

    df is first one row per unit; the replicates are a partial sum each, so nothing is gathered.
    """
    rep = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = portable_uniform(seed, unit, "_k")
    w = poisson_weight(u)
    means = rep.groupBy("_k").agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0))).alias("v"))
    return means.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def block_bootstrap_ratio(blocks: DataFrame, unit: str, top: str, bottom: str, draws: int, seed: int) -> DataFrame:
    """n, mean, low, high of sum(top) / sum(bottom) over resampled blocks, and the share of draws above 1."""
    rep = blocks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = poisson_weight(portable_uniform(seed, unit, "_k"))
    sums = rep.groupBy("_k").agg(ratio(F.sum(w * F.col(top)), F.sum(w * F.col(bottom))).alias("v"))
    return sums.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"), F.avg((F.col("v") > 1).cast("double")).alias("share_above_1"))


def sign_test(df: DataFrame, delta: str) -> DataFrame:
    """wins, n (no ties), two-sided p by the normal approximation."""
    d = F.col(delta)
    sums = df.agg(F.count_if(d > 0).alias("wins"), F.count_if(d != 0).alias("n"))
    z = F.abs(F.col("wins") - F.col("n") / 2.0) / F.sqrt(F.nullif(F.col("n"), F.lit(0)) / 4.0)
    return sums.select("wins", "n", erfc(z / F.sqrt(F.lit(2.0))).alias("p"))


def wilcoxon(df: DataFrame, delta: str) -> DataFrame:
    """n (no zeros), w_plus, w_minus: sums of the average ranks of the sizes of positive and negative differences."""
    ranked = average_ranks(df.where(F.col(delta) != 0).withColumn("_abs", F.abs(delta)), [], {"_abs": "_r"})
    up, down = F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0), F.when(F.col(delta) < 0, F.col("_r")).otherwise(0.0)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(up).alias("w_plus"), F.sum(down).alias("w_minus"))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement with chances by weight: the n smallest of -ln(u) / weight."""
    k = -F.ln(portable_uniform(seed, *key) + 1e-12) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_k", k).orderBy("_k", *key).limit(n).drop("_k")


def match_quantiles(pool: DataFrame, value: str, edges: list[float], want: list[int], seed: int, *key: str) -> DataFrame:
    """For every bin between edges, up to want[bin] rows of the pool by hash; bins may stay short."""
    b = sum((F.col(value) >= e).cast("int") for e in edges)
    wanted = F.element_at(F.array(*map(F.lit, want)), F.col("bin") + 1)
    return first_per_group(pool.withColumn("bin", b), ["bin"], wanted, [portable_hash(seed, *key), *key], *key)


def farthest_points(df: DataFrame, key: str, coords: list[str], n: int) -> DataFrame:
    """(key, nth): starts with the smallest key, then always the point farthest from those chosen, ties to the smaller key.

    One aggregation per point chosen, so n is meant to be small; only chosen points come to the driver.
    """
    spark = df.sparkSession
    first = df.orderBy(key).select(key, *coords).first()
    chosen = [first] if first else []
    while chosen and len(chosen) < n:
        d2 = None
        for c in chosen:
            one = sum((F.col(x) - F.lit(float(c[x]))) * (F.col(x) - F.lit(float(c[x]))) for x in coords)
            d2 = one if d2 is None else F.least(d2, one)
        left = df.where(~F.col(key).isin([c[key] for c in chosen])).select(key, *coords, d2.alias("_d"))
        nxt = left.orderBy(F.desc("_d"), key).first()
        if nxt is None:
            break
        chosen.append(nxt)
    return spark.createDataFrame([(c[key], i) for i, c in enumerate(chosen)], f"{key} {dict(df.dtypes)[key]}, nth int")
