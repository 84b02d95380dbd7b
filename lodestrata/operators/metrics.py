"""Scores of predictions per key from sufficient statistics, and the reports built from them.

Everything is in long form: one row per (run, channel, ...) and prediction. Scores are one partial and
one final aggregation whatever the number of channels or models.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import both_finite, finite, ratio
from ..plans.shared import cut

#: Direction of each metric: 1 means larger is better.
BETTER = {"r2": 1, "corr": 1, "rmse": -1, "mae": -1, "rmse_z": -1}
SCORES = ("r2", "corr", "rmse", "mae")


def _sums(y: str, p: str) -> dict[str, Column]:
    ok = both_finite(y, p)
    yy, pp = F.when(ok, F.col(y).cast("double")), F.when(ok, F.col(p).cast("double"))
    e = pp - yy
    return {"n": F.count(yy), "_vy": F.var_pop(yy), "_vp": F.var_pop(pp), "_c": F.covar_pop(yy, pp), "_se": F.sum(e * e), "_ae": F.sum(F.abs(e)), "bias": F.avg(e)}


def _finish(sums: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    both = F.nullif(F.sqrt(F.col("_vy")) * F.sqrt(F.col("_vp")), F.lit(0.0))
    return sums.select(
        *keys,
        "n",
        (1 - ratio("_se", n * F.nullif(F.col("_vy"), F.lit(0.0)))).alias("r2"),
        F.when(F.sqrt("_vp") >= 1e-10, ratio("_c", both)).alias("corr"),  # a spread below rounding error is none
        F.sqrt(ratio("_se", n)).alias("rmse"),
        ratio("_ae", n).alias("mae"),
        "bias",
    )


def score(pairs: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """keys, n, r2, corr, rmse, mae, bias over the pairs where both values are finite.

    r2 is null for a constant truth, corr for a constant truth or prediction. Second moments are central ones that
    merge between partitions, so large means do not cancel them.
    """
    return _finish(pairs.groupBy(*keys).agg(*[v.alias(k) for k, v in _sums(y, p).items()]), keys)


def score_models(wide: DataFrame, keys: list[str], models: list[str], y: str = "y_true") -> DataFrame:
    """score() of several predictions that stand side by side: keys, model, ...; the rows are aggregated once and only the
    sums are turned into rows, so nothing is multiplied by the number of models before the shuffle."""
    sums = {m: _sums(y, m) for m in models}
    out = wide.groupBy(*keys).agg(*[F.struct(*[v.alias(k) for k, v in s.items()]).alias(f"_m_{m}") for m, s in sums.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"_m_{m}.{k}").alias(k) for k in sums[m]]) for m in models])).alias("_r")
    return _finish(out.select(*keys, rows).select(*keys, "_r.*"), [*keys, "model"])


def score_z(pairs: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred", sigma: str | None = None) -> DataFrame:
    """keys, n, rmse_z, corr, r2 (and mean_sigma) of values that are z-scored by the truth's own mean and deviation."""
    out = score(pairs, keys, y, p).withColumn("rmse_z", F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0))))
    if sigma:
        spread = pairs.groupBy(*keys).agg(F.avg(finite(sigma)).alias("mean_sigma"))
        out = out.join(spread, keys)
    return out.select(*keys, "n", "rmse_z", "corr", "r2", *(["mean_sigma"] if sigma else []))


#: Rows of a range of values that one task ranks; small tables are cut no finer than LEAST_ROWS for more tasks.
WINDOW_ROWS, LEAST_ROWS = 1 << 20, 1 << 16


def spearman(pairs: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """keys, spearman: correlation of average ranks of doubles; null where all values of a side are equal. Nulls come first, NaN last."""
    return spearman_models(pairs, keys, [p], y).select(*keys, "spearman")


def spearman_models(wide: DataFrame, keys: list[str], models: list[str], y: str = "y_true") -> DataFrame:
    """keys, model, spearman of several predictions that stand side by side.

    Rows are dealt into ranges of (keys, y), where the truth is ranked once, and then, a row for each model, into ranges of (keys, model, prediction). Both
    ranks are those within a range; a range's sums are shifted by the rows of its key in the ranges before it, once all are known. Rows travel twice and are joined with nothing.
    Equal truths may lie in several ranges: they are the first or last of each, and their rank follows from the counts of all. Equal
    predictions of a range of truths are one row with their sums. So a value that many rows hold is no large task on either side.
    """
    narrow = cut(wide.select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(m).cast("double").alias(f"_p{k}") for k, m in enumerate(models)]), "pairs")
    n, own = narrow.count(), narrow.select(*keys).schema
    parts = max(1, -(-n // max(WINDOW_ROWS, 1)), min(narrow.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    shape = lambda more: StructType([*own.fields, *StructType.fromDDL(more).fields])
    dealt = narrow.repartitionByRange(parts, *keys, "_y", F.rand(7)).withColumn("_part", F.spark_partition_id())
    ranked = dealt.mapInArrow(_truth_ranks(keys, len(models)), shape("_m int, _v double, _at int, _n long, _s double, _s2 double, _below long"))
    again = ranked.repartitionByRange(parts * len(models), *keys, "_m", "_v").withColumn("_part", F.spark_partition_id())
    sums = cut(again.mapInArrow(_range_sums(keys), shape("_m int, _v double, _at int, _n long, _s double, _s2 double, _below long, _part int, _q double, _x double, _kinds long")), "sums")

    def before(rows: DataFrame, of: list[str]) -> DataFrame:
        """Rows of a key in the ranges before each, and in all."""
        held = rows.groupBy(*of, "_part").agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*of)
        return held.select(*of, "_part", (F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"), F.sum("_n").over(w).alias("_all"))

    # twice the ranks, less twice their mean: what a range lacks is one number for its inner values, and one for its first and last
    truths = sums.where("_m < 0").withColumn("_part", F.floor(F.col("_at") / 3).cast("int"))
    truths = _null_safe(truths, before(truths, keys), [*keys, "_part"])
    same = Window.partitionBy(*keys, "_v")
    doubled = F.when(F.col("_at") % 3 == 0, 2.0 * F.col("_off")).otherwise(2.0 * F.min(F.col("_off") + F.col("_below")).over(same) + F.col("_edge") + 1.0)
    edge = F.sum(F.when(F.col("_at") % 3 != 0, F.col("_n"))).over(same)
    inner = truths.where("_at % 3 = 0").withColumn("_edge", F.lit(0).cast("long"))
    outer = truths.where("_at % 3 <> 0").withColumn("_edge", edge)
    truths = cut(inner.withColumn("_o", 2.0 * F.col("_off") - F.col("_all") - 1).unionByName(outer.withColumn("_o", doubled - F.col("_all") - 1)), "truths")
    spread = truths.groupBy(*keys).agg(F.sum(F.col("_s2") + 2 * F.col("_o") * F.col("_s") + F.col("_o") * F.col("_o") * F.col("_n")).alias("_a"))

    predicted = sums.where("_m >= 0")
    shifts = before(predicted.where("_at >= 0"), [*keys, "_m"])
    predicted = _null_safe(predicted, shifts, [*keys, "_m", "_part"]).withColumn("_p", 2.0 * F.col("_off") - F.col("_all") - 1)
    other = predicted.where("_at < 0").groupBy(*keys, "_m").agg(F.sum(F.col("_x") + 2 * F.col("_p") * F.col("_q") + F.col("_p") * F.col("_p") * F.col("_n")).alias("_b"), F.sum("_kinds").alias("_kinds"))
    met = _null_safe(predicted.where("_at >= 0"), truths.select(*keys, "_at", "_o"), [*keys, "_at"])
    met = met.groupBy(*keys, "_m").agg(F.sum(F.col("_x") + F.col("_p") * F.col("_s") + F.col("_o") * F.col("_q") + F.col("_o") * F.col("_p") * F.col("_n")).alias("_c"))
    out = _null_safe(_null_safe(met, other, [*keys, "_m"]), spread, keys)
    named = F.element_at(F.array(*map(F.lit, models)), F.col("_m") + 1).alias("model")
    return out.select(*keys, named, F.when((F.col("_kinds") > 1) & (F.col("_a") > 0), F.col("_c") / F.sqrt(F.col("_a") * F.col("_b"))).alias("spearman"))


def _codes(whole: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row that tells its key, from 0, and a row of each."""
    code = np.zeros(len(whole), dtype=np.int64)
    for name in names:
        kind = whole[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * len(kind.dictionary) + kind.indices.to_numpy()
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


class _Order:
    """Rows by code and value (nulls first, NaN last): their order, the runs of equal ones, and twice their mean rank within the code."""

    def __init__(self, code: np.ndarray, column: pa.ChunkedArray, weights: np.ndarray | None = None):
        value = column.to_numpy()
        rank = np.where(np.isnan(value), 2, 1)
        rank[column.is_null().to_numpy()] = 0
        value = np.where(rank == 1, value, 0.0)
        self.order = np.lexsort((value, rank, code))
        c, v, k = code[self.order], value[self.order], rank[self.order]
        self.start = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (v[1:] != v[:-1]) | (np.diff(k) != 0)]))
        self.code = c[self.start]
        held = np.diff(np.append(self.start, len(c))) if weights is None else np.add.reduceat(weights[self.order], self.start)
        whole = np.cumsum(held) - held
        self.first = np.concatenate([[True], np.diff(self.code) != 0])
        self.last = np.append(self.first[1:], True)
        self.held, self.below = held, whole - whole[np.flatnonzero(self.first)][np.cumsum(self.first) - 1]
        self.run = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(c))))
        self.doubled = 2.0 * self.below + held + 1.0


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def _truth_ranks(keys: list[str], models: int):
    """Of a range of truths: a row for each model, key, place (3 x the range: inner values, + 1: the first, + 2: the last one) and
    prediction with its count and sum of ranks, which inner values have; and for model -1 what each place holds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        code, _ = _codes(whole, keys)
        by = _Order(code, whole["_y"])
        place = 3 * whole["_part"][0].as_py() + np.where(by.first, 1, np.where(by.last, 2, 0))
        rank = np.where(place % 3 == 0, by.doubled, 0.0)

        def rows(model: int, at: np.ndarray, value: str, place: np.ndarray, n: np.ndarray, s: np.ndarray, s2: np.ndarray, below: np.ndarray) -> pa.Table:
            made = whole.select([*keys, value]).take(pa.array(at)).rename_columns([*keys, "_v"])
            for name, column, kind in (("_m", np.full(len(at), model), pa.int32()), ("_at", place, pa.int32()), ("_n", n, pa.int64()), ("_s", s, pa.float64()), ("_s2", s2, pa.float64()), ("_below", below, pa.int64())):
                made = made.append_column(name, pa.array(column).cast(kind))
            return made.select([*keys, "_m", "_v", "_at", "_n", "_s", "_s2", "_below"])

        inner, runs = place % 3 == 0, np.flatnonzero(place % 3 != 0)
        yield from rows(-1, by.order[by.start[runs]], "_y", place[runs], by.held[runs], 0.0 * runs, 0.0 * runs, by.below[runs]).to_batches()
        if inner.any():
            of_code = np.flatnonzero(np.bincount(by.code[inner]))
            some = np.zeros(len(by.first.nonzero()[0]), dtype=np.int64)
            some[by.code] = by.order[by.start]
            add = lambda w: np.bincount(by.code[inner], weights=w[inner])[of_code]
            zeros = 0 * of_code
            base = 3 * whole["_part"][0].as_py() + zeros
            yield from rows(-1, some[of_code], "_y", base, add(by.held).astype(np.int64), add(by.held * rank), add(by.held * rank * rank), zeros).to_batches()
        at, s = np.empty(len(whole), dtype=np.int64), np.empty(len(whole))
        at[by.order], s[by.order] = place[by.run], rank[by.run]
        for model in range(models):
            alike = _Order(3 * code + at % 3, whole[f"_p{model}"])
            first = alike.order[alike.start]
            nothing = 0 * first
            yield from rows(model, first, f"_p{model}", at[first], alike.held, np.add.reduceat(s[alike.order], alike.start), nothing, nothing).to_batches()

    return of


def _range_sums(keys: list[str]):
    """Of a range of predictions: for each key, model and place of the truth the count and the sums of ranks and of their products; at place -1
    the sum of squares and how many values there are. What the truths hold passes through."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        part = whole["_part"][0].as_py()

        def rows(made: pa.Table, **columns: np.ndarray) -> pa.Table:
            for name, kind in (("_at", pa.int32()), ("_n", pa.int64()), ("_s", pa.float64()), ("_q", pa.float64()), ("_x", pa.float64()), ("_kinds", pa.int64())):
                if name in columns or name not in made.column_names:
                    column = pa.array(columns.get(name, np.zeros(len(made)))).cast(kind)
                    made = made.set_column(made.column_names.index(name), name, column) if name in made.column_names else made.append_column(name, column)
            made = made.set_column(made.column_names.index("_part"), "_part", pa.array(np.full(len(made), part, dtype=np.int32)))
            return made.select([*keys, "_m", "_v", "_at", "_n", "_s", "_s2", "_below", "_part", "_q", "_x", "_kinds"])

        truth = pc.less(whole["_m"], 0)
        yield from rows(whole.filter(truth)).to_batches()
        whole = whole.filter(pc.invert(truth))
        if not len(whole):
            return
        code, some = _codes(whole, [*keys, "_m"])
        n, s, at = whole["_n"].to_numpy(), whole["_s"].to_numpy(), whole["_at"].to_numpy()
        by = _Order(code, whole["_v"], n)
        rank = np.empty(len(whole))
        rank[by.order] = by.doubled[by.run]
        total = lambda w: np.bincount(by.code, weights=w, minlength=len(some))
        n_all = total(by.held)
        yield from rows(whole.take(pa.array(some)), _at=np.full(len(some), -1), _n=n_all, _s=0 * n_all, _q=total(by.held * by.doubled), _x=total(by.held * by.doubled**2), _kinds=total(np.ones(len(by.code)))).to_batches()
        span = int(at.max()) + 1
        _, first, group = np.unique(code * span + at, return_index=True, return_inverse=True)
        add = lambda w: np.bincount(group, weights=w)
        yield from rows(whole.take(pa.array(first)), _n=add(n), _s=add(s), _q=add(n * rank), _x=add(s * rank)).to_batches()

    return of


def average_ranks(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """df with ranks within keys from 1 of each of the values (column: name of its rank); equal values share the mean of their places.

    Approximate quantiles split the values of a key, as many as there are shuffle partitions. A row's rank is that in
    its part plus the rows of its key in the parts before. Rows that equal a split are a part of their own, of which the count says all, so
    a value which many rows hold is sorted nowhere; of any other value a task has few. Nulls come first, NaN last.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    fine = lambda v: F.col(v).isNotNull() & ~F.isnan(v)
    # splits only balance the parts, so a sample sets them, as it does for ranges
    splits = df.sample(0.05, seed=1).groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(F.when(fine(v), F.col(v)), shares, 50 * parts))).alias(f"_s_{v}") for v in values])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])

    def part(v: str) -> Column:
        s, x = F.col(f"_s_{v}"), F.col(v)
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(s, at + step - 1) < x, F.lit(False)), at + step).otherwise(at))
        inside = F.transform(F.array(below), lambda n: 2 * n + F.when(F.coalesce(F.get(s, n) == x, F.lit(False)), 1).otherwise(0))[0]
        return F.when(x.isNull(), F.lit(-1)).when(F.isnan(x), F.lit(2 * parts + 1)).otherwise(inside)

    # written once: splits are approximate, so a second evaluation could draw other ones
    held = cut(_null_safe(df, splits, keys, "left").select(*df.columns, *[part(v).alias(f"_b_{v}") for v in values]), "parts")
    out = held
    for v, name in values.items():
        b = f"_b_{v}"
        counts = held.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
        met = _null_safe(out, counts.withColumn("_before", F.coalesce(before, F.lit(0))), [*keys, b])
        alike = met.where(F.col(b) % 2 != 0).withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2.0)
        place = F.rank().over(Window.partitionBy(*keys, b).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, b, v)) - 1) / 2.0
        out = met.where(F.col(b) % 2 == 0).withColumn(name, F.col("_before") + place).unionByName(alike).drop("_n", "_before")
    return out.select(*df.columns, *values.values())


def _null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name, where nulls meet nulls."""
    if not on:  # b is one row
        return a.crossJoin(F.broadcast(b))
    own = b.withColumnsRenamed({c: f"_on{k}" for k, c in enumerate(on)})
    return a.join(own, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on{k}")) for k, c in enumerate(on)]), how).drop(*[f"_on{k}" for k in range(len(on))])


def summary(df: DataFrame, keys: list[str], metrics=SCORES, stats=("mean", "median"), extra: list[Column] = ()) -> DataFrame:
    """Mean, median, min, max of metrics per key; NaN and infinite values are left out, and nothing gives null."""
    how = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    aggs = [how[s](finite(m)).alias(f"{m}_{s}") for m in metrics for s in stats]
    return df.groupBy(*keys).agg(*extra, *aggs)


def report(df: DataFrame, sets: list[list[str]], metrics=SCORES) -> DataFrame:
    """summary() for several key sets at once: one pass by grouping sets; level tells which set a row belongs to."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    aggs = [F.countDistinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_rows")]
    aggs += [f(finite(m)).alias(f"{m}_{s}") for m in metrics for s, f in (("mean", F.avg), ("median", F.median))]
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("level"), *aggs)


def leaderboard(df: DataFrame, metric: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Rows ranked by a metric in its own direction; null, NaN and infinite values come last."""
    value = finite(metric) * BETTER.get(metric, 1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc_nulls_last(), *tie))
    return df.withColumn("place", place)


def uplift(full: DataFrame, single: DataFrame, channel: str = "channel", metric: str = "r2") -> DataFrame:
    """Of full models against the best single one on each channel: medians, mean and median gain, share of gains."""
    best = single.groupBy(channel).agg(F.max(finite(metric)).alias("_best"))
    met = full.join(best, channel).withColumn("_d", finite(metric) - F.col("_best"))
    return met.groupBy("model").agg(
        F.count("_d").alias("n_channels"),
        F.median(finite(metric)).alias(f"{metric}_full_median"),
        F.median("_best").alias(f"{metric}_best_single_median"),
        F.avg("_d").alias(f"d_{metric}_mean"),
        F.median("_d").alias(f"d_{metric}_median"),
        F.avg((F.col("_d") > 0).cast("double")).alias("win_rate"),
    )


def paired_t(df: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """n, mean, t of differences; t is null for one or no spread."""
    sums = df.groupBy(*keys).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("_sd"))
    return sums.select(*keys, "n", "mean_delta", ratio("mean_delta", F.nullif(F.col("_sd") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))).alias("t"))
