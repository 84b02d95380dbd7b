"""Bins, correlograms, explained variance, spectra of small matrices and other statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, ratio
from .metrics import average_ranks


def digitise(value: Column | str, edges: list[float]) -> Column:
    """How many edges a value reaches: 0 below the first."""
    v = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, b: a + b, [(v >= e).cast("int") for e in edges])


def uniform_bin(value, low, high, bins: int) -> Column:
    """Bins of equal width from 0; the upper end belongs to the last one."""
    lo, hi = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    v = F.col(value) if isinstance(value, str) else value
    return F.least(F.greatest(F.floor((v - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Exact inner quantiles: bins - 1 numbers."""
    qs = [k / bins for k in range(1, bins)]
    return list(df.agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("q")).first()["q"])


def variogram(pairs: DataFrame, keys: list[str], distance: str, a: str, b: str, bin_column: Column) -> DataFrame:
    """keys, bin, n, h (mean distance), cov (mean product), gamma (half mean squared difference)."""
    d = F.col(a) - F.col(b)
    return pairs.groupBy(*keys, bin_column.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("h"), F.avg(F.col(a) * F.col(b)).alias("cov"), (F.avg(d * d) / 2).alias("gamma"))


def correlogram(pairs: DataFrame, bin_column: Column, same: Column, product: Column) -> DataFrame:
    """bin, inside, across, gap, n_inside, n_across: mean product over pairs of one region and of two."""
    out = pairs.groupBy(bin_column.alias("bin")).agg(
        F.avg(F.when(same, product)).alias("inside"), F.avg(F.when(~same, product)).alias("across"), F.count_if(same).alias("n_inside"), F.count_if(~same).alias("n_across")
    )
    return out.withColumn("gap", F.col("inside") - F.col("across"))


def relative_to_first(df: DataFrame, order: str, value: str, decayed: float = 0.05) -> Column:
    """A value over the first one along an order; null where that is not more than the given share."""
    first = F.first(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.abs(F.col(value)) >= decayed * F.abs(first), ratio(F.col(value), first))


def eta_squared(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, n, n_groups, eta2: share of variance between groups; the groups' sums are all that is joined."""
    v = finite(value)
    g = df.groupBy(*keys, group).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v")).where("_n > 0")
    n, m = F.col("_n"), F.col("_m")
    s = g.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(n * m).alias("_s"), F.sum(n * m * m).alias("_q"), F.sum(n * F.col("_v")).alias("_w"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    return s.select(*keys, "n", "n_groups", ratio(between, F.nullif(between + F.col("_w"), F.lit(0.0))).alias("eta2"))


def held_out_group_mean(df: DataFrame, keys: list[str], group: str, fold: str, value: str) -> DataFrame:
    """keys, fold, n, ev: how well the other folds' group means (their grand mean for unseen groups) explain a fold.

    Means of all but one fold are differences of sums, so one aggregation to (keys, group, fold) serves all folds.
    """
    cell = df.groupBy(*keys, group, fold).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    w, a = Window.partitionBy(*keys, group), Window.partitionBy(*keys)
    f = Window.partitionBy(*keys, fold)
    out = cell.withColumns({"gn": F.sum("n").over(w) - F.col("n"), "gs": F.sum("s").over(w) - F.col("s"), "an": F.sum("n").over(a) - F.sum("n").over(f), "as_": F.sum("s").over(a) - F.sum("s").over(f)})
    mean = F.when(F.col("gn") > 0, F.col("gs") / F.col("gn")).otherwise(F.col("as_") / F.nullif(F.col("an"), F.lit(0)))
    out = out.withColumn("m", mean).withColumn("t", F.col("as_") / F.nullif(F.col("an"), F.lit(0)))
    ssr = F.sum(F.col("q") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") * F.col("m"))
    sst = F.sum(F.col("q") - 2 * F.col("t") * F.col("s") + F.col("n") * F.col("t") * F.col("t"))
    return out.groupBy(*keys, fold).agg(F.sum("n").alias("n"), (1 - ratio(ssr, F.nullif(sst, F.lit(0.0)))).alias("ev"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns, by one aggregation over the wide table; null for constants."""
    aggs, pairs = [], [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    for a, b in pairs:
        aggs.append(ratio(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias(f"{a}|{b}"))
    wide = df.agg(*aggs)
    return wide.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def spectrum_summary(spark: SparkSession, corr: DataFrame, columns: list[str]) -> DataFrame:
    """pc1_share, participation_ratio, n90, n95 of a correlation matrix of a few hundred channels, on the driver."""
    import numpy as np

    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for row in corr.collect():  # channels squared, whatever the number of rows behind them
        m[at[row["a"]], at[row["b"]]] = m[at[row["b"]], at[row["a"]]] = row["corr"] or 0.0
    lam = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
    share = lam / lam.sum()
    c = np.cumsum(share)
    return spark.createDataFrame([(float(share[0]), float(1 / (share**2).sum()), int((c < 0.9 - 1e-12).sum() + 1), int((c < 0.95 - 1e-12).sum() + 1))], "pc1_share double, participation_ratio double, n90 int, n95 int")


def geometric_mean(value: Column | str) -> Column:
    """Aggregate: exp of the mean log over finite values; any zero gives 0."""
    v = finite(value)
    return F.when(F.min(v) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.when(v > 0, F.ln(v)))))


def weighted_std(value: str, weight: str, least: int = 10) -> list[Column]:
    """Aggregates n, sw, swy, swyy over positive weights and finite values; see finish_weighted_std."""
    ok = (F.col(weight) > 0) & finite(value).isNotNull()
    w, y = F.when(ok, F.col(weight)), F.when(ok, F.col(value))
    return [F.count(w).alias("n"), F.sum(w).alias("_w"), F.sum(w * y).alias("_wy"), F.sum(w * y * y).alias("_wyy")]


def finish_weighted_std(least: int = 10) -> Column:
    mean = F.col("_wy") / F.col("_w")
    return F.when(F.col("n") >= least, F.sqrt(F.greatest(F.col("_wyy") / F.col("_w") - mean * mean, F.lit(0.0))))


def log_slope(df: DataFrame, x: str, y: str, name: str = "slope") -> DataFrame:
    """Local slope of ln y over ln x along x: differences on unequal steps inside, one-sided at the ends."""
    w = Window.orderBy(x)
    lx, ly = F.ln(x), F.ln(y)
    out = df.withColumns({"_x": lx, "_y": ly}).withColumns({"_x0": F.lag("_x").over(w), "_x1": F.lead("_x").over(w), "_y0": F.lag("_y").over(w), "_y1": F.lead("_y").over(w)})
    c = F.col
    hs, hd = c("_x") - c("_x0"), c("_x1") - c("_x")
    inner = (hs * hs * c("_y1") + (hd * hd - hs * hs) * c("_y") - hd * hd * c("_y0")) / (hs * hd * (hs + hd))
    slope = F.when(c("_x0").isNull(), (c("_y1") - c("_y")) / hd).when(c("_x1").isNull(), (c("_y") - c("_y0")) / hs).otherwise(inner)
    return out.withColumn(name, slope).select(*df.columns, name)


def running_share(df: DataFrame, order: list[Column], weight: str) -> DataFrame:
    """share, running share and rank (k) of weights in an order, by ranges that are scanned apart."""
    from .bins import global_rank

    total = df.agg(F.sum(weight).alias("_total"))
    ranked = global_rank(df, order, "k", running={"running": weight}).crossJoin(F.broadcast(total))
    out = ranked.withColumn("share", F.col(weight) / F.col("_total")).withColumn("running", F.col("running") / F.col("_total"))
    return out.withColumn("k", F.col("k") + 1).select(*df.columns, "share", "k", "running")


def ddpm_schedule(spark: SparkSession, steps: int, first: float, last: float) -> DataFrame:
    """(t, beta, abar, posterior): a linear noise schedule, its running product and posterior variances."""
    t = F.col("id")
    b = spark.range(steps).select(t.alias("t"), (first + (last - first) * t / float(steps - 1)).alias("beta"))
    w = Window.orderBy("t")
    out = b.withColumn("abar", F.exp(F.sum(F.ln(1 - F.col("beta"))).over(w)))
    before = F.coalesce(F.lag("abar").over(w), F.lit(1.0))
    return out.withColumn("posterior", F.col("beta") * (1 - before) / (1 - F.col("abar")))


def ranks_corr(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    ranked = average_ranks(df, keys, {a: "_ra", b: "_rb"})
    return ranked.groupBy(*keys).agg(ratio(F.covar_pop("_ra", "_rb"), F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))).alias("rho"))
