"""Histograms, rasters, correlograms, explained variance, learners and other statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import learn, metrics, sampling, spatial, stats
from .q_graph import PD2, POINTS, points
from .registry import Catalog, R, r, t

CATALOG = Catalog()
add = CATALOG.add
CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@add("A17_coverage", f"SELECT event_type, {R('avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END)')} AS coverage, {R('avg(ln(1 + greatest(value, 0)))')} AS mean, {R('median(ln(1 + greatest(value, 0)))')} AS median, {R('quantile_cont(ln(1 + greatest(value, 0)), 0.99)')} AS p99 FROM events GROUP BY 1")
def a17(spark, sf):
    v = x.log1p_clipped("value")
    return t(spark, sf, "events").groupBy("event_type").agg(r(F.avg((F.col("value") > 50).cast("double"))).alias("coverage"), r(F.avg(v)).alias("mean"), r(F.median(v)).alias("median"), r(F.percentile(v, F.lit(0.99))).alias("p99"))


def _corr(a, b):
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


_PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS corr FROM lineitem" for a, b in _PAIRS)


@add("A18_correlations", f"SELECT a, b, {R('corr')} AS corr FROM ({_CORR})")
def a18(spark, sf):
    return stats.correlation_pairs(t(spark, sf, "lineitem"), CHANNELS).select("a", "b", r("corr").alias("corr"))


@add("A19_off_diagonal", f"SELECT {R('avg(abs(corr))')} AS mean_abs, {R('avg(CASE WHEN abs(corr) > 0.5 THEN 1.0 ELSE 0 END)')} AS strong, {R('avg(CASE WHEN corr < 0 THEN 1.0 ELSE 0 END)')} AS negative FROM ({_CORR})")
def a19(spark, sf):
    c = stats.correlation_pairs(t(spark, sf, "lineitem"), CHANNELS)
    return c.agg(r(F.avg(F.abs("corr"))).alias("mean_abs"), r(F.avg((F.abs("corr") > 0.5).cast("double"))).alias("strong"), r(F.avg((F.col("corr") < 0).cast("double"))).alias("negative"))


@add("A20_T8_spectrum")
def a20(spark, sf):
    return stats.spectrum_summary(spark, stats.correlation_pairs(t(spark, sf, "lineitem"), CHANNELS), CHANNELS).select(r("pc1_share").alias("pc1_share"), r("participation_ratio").alias("participation_ratio"), "n90", "n95")


@add("A21_eta_squared", f"WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1, 2), s AS (SELECT c_mktsegment, sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g GROUP BY 1) SELECT c_mktsegment, CAST(n AS BIGINT) AS n, k AS n_groups, {R('(q - s * s / n) / nullif(q - s * s / n + w, 0)')} AS eta2 FROM s")
def a21(spark, sf):
    return stats.eta_squared(t(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal").select("c_mktsegment", "n", "n_groups", r("eta2").alias("eta2"))


@add("A22_geometric_mean", f"SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, {R('CASE WHEN min(l_discount) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN l_discount > 0 THEN l_discount END))) END')} AS v FROM lineitem GROUP BY 1, 2")
def a22(spark, sf):
    return t(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y")).agg(r(stats.geometric_mean("l_discount")).alias("v"))


@add("A23_A24_donor_survival", f"""WITH m AS (SELECT p_type, max(p_retailprice) AS hi FROM part GROUP BY 1), s AS (SELECT p_type, avg(CASE WHEN p_retailprice / hi * 255 >= 127 THEN 1.0 ELSE 0 END) AS s FROM part JOIN m USING (p_type) GROUP BY 1)
SELECT {R("median(s)")} AS mid, {R("min(s)")} AS lo, {R("max(s)")} AS hi FROM s""")
def a23(spark, sf):
    p = t(spark, sf, "part").select("p_type", "p_retailprice")
    hi = p.groupBy("p_type").agg(F.max(F.when(F.col("p_retailprice") > 0, F.col("p_retailprice"))).alias("hi"))
    s = p.join(hi, "p_type").groupBy("p_type").agg(F.avg((F.col("p_retailprice") / F.col("hi") * 255 >= 127).cast("double")).alias("s"))
    return s.agg(r(F.median("s")).alias("mid"), r(F.min("s")).alias("lo"), r(F.max("s")).alias("hi"))


@add("A25_A26_A28_R9_rasters", f"SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, l_linestatus AS section, {R('avg(l_extendedprice)', 3)} AS mean, {R('max(l_extendedprice)', 3)} AS top, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def a25(spark, sf):
    return t(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), F.col("l_linestatus").alias("section")).agg(r(F.avg("l_extendedprice"), 3).alias("mean"), r(F.max("l_extendedprice"), 3).alias("top"), F.count(F.lit(1)).alias("n"))


@add("A27_mergeable_accumulators", f"SELECT event_type, {R('sum(value) / count(value)')} AS mean, count(value) AS n FROM events GROUP BY 1")
def a27(spark, sf):
    e = t(spark, sf, "events")
    acc = lambda df: df.groupBy("event_type").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    both = acc(e.where("user_id % 2 = 0")).unionByName(acc(e.where("user_id % 2 = 1")))
    return both.groupBy("event_type").agg(r(F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


@add("A29_A31_A62_pool_to_nodes", f"""WITH p AS (SELECT l_suppkey AS node, avg(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3), s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM p) SELECT node, n, {R("(v - m) / (d + 1e-8)")} AS z FROM p, s""")
def a29(spark, sf):
    from ..operators.clean import ZScore

    p = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.avg("l_extendedprice").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return ZScore.fit(p, ["v"], ddof=0, eps=1e-8).transform(p).select("node", "n", r("v").alias("z"))


@add("A30_cells_with_enough", f"SELECT CAST(floor(l_partkey / 50) AS BIGINT) AS cell, {R('avg(l_quantity)')} AS q, {R('avg(l_tax)')} AS tax, count(*) AS n FROM lineitem GROUP BY 1 HAVING least(count(l_quantity), count(l_tax)) >= 20")
def a30(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.floor(F.col("l_partkey") / 50).alias("cell")).agg(r(F.avg("l_quantity")).alias("q"), r(F.avg("l_tax")).alias("tax"), F.count(F.lit(1)).alias("n"), F.least(F.count("l_quantity"), F.count("l_tax")).alias("least"))
    return g.where("least >= 20").drop("least")


_BLOCKS = f"""WITH {POINTS}, q AS (SELECT a.label AS la, b.label AS lb, a.id % 20 AS block, abs(a.z - b.z) AS d FROM p a JOIN p b ON a.id < b.id AND {PD2} <= 0.0225),
k AS (SELECT block, sum(CASE WHEN la <> lb THEN d ELSE 0 END) AS cs, sum(CASE WHEN la <> lb THEN 1 ELSE 0 END) AS cn, sum(CASE WHEN la = lb THEN d ELSE 0 END) AS ws, sum(CASE WHEN la = lb THEN 1 ELSE 0 END) AS wn FROM q GROUP BY block)"""


def blocks(spark, sf):
    p = points(spark, sf)
    met = spatial.radius_join(p, p, ["x", "y", "z"], 0.15).where("l_id < r_id")
    cross = F.col("l_label") != F.col("r_label")
    d = F.abs(F.col("l_z") - F.col("r_z"))
    one = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    return met.groupBy((F.col("l_id") % 20).alias("block")).agg(one(cross, d).alias("cs"), one(cross, F.lit(1.0)).alias("cn"), one(~cross, d).alias("ws"), one(~cross, F.lit(1.0)).alias("wn"))


@add("A32_A33_boundary_contrast", f"{_BLOCKS} SELECT {R('sum(cs) / sum(cn)')} AS across, {R('sum(ws) / sum(wn)')} AS inside, {R('sum(cs) / sum(cn) / (sum(ws) / sum(wn))')} AS contrast FROM k")
def a33(spark, sf):
    out = blocks(spark, sf).agg((F.sum("cs") / F.sum("cn")).alias("across"), (F.sum("ws") / F.sum("wn")).alias("inside"))
    return out.select(r("across").alias("across"), r("inside").alias("inside"), r(F.col("across") / F.col("inside")).alias("contrast"))


@add("B6_block_bootstrap", f"""{_BLOCKS}, w AS (SELECT j, cs, ws, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END AS w
  FROM (SELECT j, cs, ws, CAST(('0x' || substr(md5('5:' || block || ':' || j), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM k, range(100) g(j))),
m AS (SELECT j, sum(w * cs) / nullif(sum(w * ws), 0) AS v FROM w GROUP BY j) SELECT count(v) AS n, {R("avg(v)", 4)} AS mean, {R("quantile_cont(v, 0.025)", 4)} AS low, {R("quantile_cont(v, 0.975)", 4)} AS high, {R("avg(CASE WHEN v > 1 THEN 1.0 ELSE 0 END)", 4)} AS share_above_1 FROM m""")
def b6(spark, sf):
    out = sampling.block_bootstrap_ratio(blocks(spark, sf), "block", "cs", "ws", 100, 5)
    return out.select("n", *[r(c, 4).alias(c) for c in ("mean", "low", "high", "share_above_1")])


@add("A34_border_trend", f"""WITH q AS (SELECT ntile(6) OVER (ORDER BY o_totalprice, o_orderkey) AS bin, o_custkey % 100 AS v FROM orders), b AS (SELECT bin, avg(v) AS v, count(*) AS n FROM q GROUP BY bin) SELECT CAST(bin AS INTEGER) AS bin, n, {R("v / first_value(v) OVER (ORDER BY bin)")} AS relative FROM b""")
def a34(spark, sf):
    # quantile edges come from one aggregate; a global ntile would put the whole table in one task
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).alias("v"))
    from ..operators.bins import ntile_bins

    b = ntile_bins(o, "o_totalprice", "o_orderkey", 6).groupBy("bin").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    first = F.first("v").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return b.select("bin", "n", r(F.col("v") / first).alias("relative"))


@add("A35_held_out_group_mean", f"""WITH b AS (SELECT c_custkey % 4 AS fold, c_nationkey AS g, c_acctbal AS v FROM customer), f AS (SELECT DISTINCT fold FROM b),
m AS (SELECT f.fold, b.g, avg(v) AS m FROM f JOIN b ON b.fold <> f.fold GROUP BY 1, 2), a AS (SELECT f.fold, avg(v) AS m FROM f JOIN b ON b.fold <> f.fold GROUP BY 1)
SELECT b.fold, count(*) AS n, {R("1 - sum(power(v - coalesce(m.m, a.m), 2)) / nullif(sum(power(v - a.m, 2)), 0)")} AS ev FROM b JOIN a USING (fold) LEFT JOIN m ON m.fold = b.fold AND m.g = b.g GROUP BY b.fold""")
def a35(spark, sf):
    b = t(spark, sf, "customer").select((F.col("c_custkey") % 4).alias("fold"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    return stats.held_out_group_mean(b, [], "g", "fold", "v").select("fold", "n", r("ev").alias("ev"))


_VPAIRS = f"WITH {POINTS}, q AS (SELECT a.label AS la, b.label AS lb, sqrt({PD2}) AS d, a.z AS va, b.z AS vb FROM p a JOIN p b ON a.id < b.id AND {PD2} <= 0.04), b AS (SELECT *, CAST(least(floor(d / 0.2 * 8), 7) AS INTEGER) AS bin FROM q)"


def value_pairs(spark, sf):
    p = points(spark, sf)
    met = spatial.radius_join(p, p, ["x", "y", "z"], 0.2).where("l_id < r_id")
    return met.select(F.col("l_label").alias("la"), F.col("r_label").alias("lb"), F.sqrt("d2").alias("d"), F.col("l_z").alias("va"), F.col("r_z").alias("vb")).withColumn("bin", stats.uniform_bin("d", 0.0, 0.2, 8))


@add("A37_variogram", f"{_VPAIRS} SELECT bin, count(*) AS n, {R('avg(d)')} AS h, {R('avg(va * vb)')} AS cov, {R('avg(power(va - vb, 2)) / 2')} AS gamma FROM b GROUP BY bin")
def a37(spark, sf):
    v = stats.variogram(value_pairs(spark, sf).drop("bin"), [], "d", "va", "vb", stats.uniform_bin("d", 0.0, 0.2, 8))
    return v.select("bin", "n", r("h").alias("h"), r("cov").alias("cov"), r("gamma").alias("gamma"))


@add("A38_A40_A41_A63_correlogram", f"""{_VPAIRS}, c AS (SELECT bin, avg(CASE WHEN la = lb THEN va * vb END) AS i, avg(CASE WHEN la <> lb THEN va * vb END) AS o, count(*) FILTER (la = lb) AS ni, count(*) FILTER (la <> lb) AS no FROM b GROUP BY bin), f AS (SELECT *, first_value(i) OVER (ORDER BY bin) AS f FROM c)
SELECT bin, {R("i")} AS inside, {R("o")} AS across, {R("i - o")} AS gap, ni AS n_inside, no AS n_across, {R("CASE WHEN abs(i) >= 0.05 * abs(f) THEN i / nullif(f, 0) END", 4)} AS relative, {R("CASE WHEN abs(i) >= 0.05 * abs(f) THEN 100 * (i - o) / nullif(i, 0) END", 3)} AS drop_pct FROM f""")
def a38(spark, sf):
    c = stats.correlogram(value_pairs(spark, sf), F.col("bin"), F.col("la") == F.col("lb"), F.col("va") * F.col("vb"))
    c = c.withColumn("relative", stats.relative_to_first(c, "bin", "inside"))
    drop = F.when(F.col("relative").isNotNull(), 100 * x.ratio("gap", F.nullif(F.col("inside"), F.lit(0.0))))
    return c.select("bin", r("inside").alias("inside"), r("across").alias("across"), r("gap").alias("gap"), "n_inside", "n_across", r("relative", 4).alias("relative"), r(drop, 3).alias("drop_pct"))


@add("A39_distance_and_border_prize", f"""{_VPAIRS}, s AS (SELECT *, va * vb AS y, la = lb AS same FROM b), d AS (SELECT bin, count(*) AS n, avg(y) AS m FROM s GROUP BY bin HAVING count(*) > 5), e AS (SELECT bin, same, count(*) AS n, avg(y) AS m FROM s GROUP BY bin, same HAVING count(*) > 5),
j AS (SELECT s.y, d.m AS md, e.m AS me FROM s JOIN d USING (bin) JOIN e ON e.bin = s.bin AND e.same = s.same)
SELECT {R("1 - sum(power(y - md, 2)) / (count(*) * var_pop(y))")} AS by_distance, {R("1 - sum(power(y - me, 2)) / (count(*) * var_pop(y))")} AS by_both FROM j""")
def a39(spark, sf):
    s = value_pairs(spark, sf).withColumns({"y": F.col("va") * F.col("vb"), "same": F.col("la") == F.col("lb")})
    # pairs meet by partial aggregation alone: squares about any mean follow from the counts, means and variances of at most 8 x 3 groups
    n, me, v = F.col("n"), F.col("me"), F.col("v")
    of_bin, whole = Window.partitionBy("bin"), Window.partitionBy(F.lit(1))
    j = s.groupBy("bin", "same").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("me"), F.var_pop("y").alias("v"))
    j = j.withColumns({"_n": F.sum(n).over(of_bin), "md": F.sum(n * me).over(of_bin) / F.sum(n).over(of_bin)})
    j = j.where("_n > 5 and n > 5 and bin is not null and same is not null").withColumn("m", F.sum(n * me).over(whole) / F.sum(n).over(whole))
    sq = lambda c: F.sum(n * (v + (me - F.col(c)) * (me - F.col(c))))
    return j.agg(r(1 - sq("md") / sq("m")).alias("by_distance"), r(1 - F.sum(n * v) / sq("m")).alias("by_both"))


@add("A36_M1_regression_ceiling", f"""WITH b AS (SELECT l_linenumber AS fold, l_extendedprice AS y, l_quantity AS q FROM lineitem), f AS (SELECT DISTINCT fold FROM b),
m AS (SELECT f.fold, regr_slope(y, q) AS s, regr_intercept(y, q) AS i, avg(y) AS a FROM f JOIN b ON b.fold <> f.fold GROUP BY f.fold) SELECT {R("1 - sum(power(y - i - s * q, 2)) / sum(power(y - a, 2))", 5)} AS ev, count(*) AS n FROM b JOIN m USING (fold)""")
def a36(spark, sf):
    b = t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"))
    # moments of each fold once; those of all other folds are differences
    names = {"n": F.lit(1.0), "y": F.col("y"), "q": F.col("q"), "yq": F.col("y") * F.col("q"), "qq": F.col("q") * F.col("q"), "yy": F.col("y") * F.col("y")}
    s = b.groupBy("fold").agg(*[F.sum(v).alias(k) for k, v in names.items()])
    total = Window.partitionBy(F.lit(1))
    s = s.withColumns({f"t_{k}": F.sum(k).over(total) - F.col(k) for k in names})
    c = F.col
    slope = (c("t_n") * c("t_yq") - c("t_y") * c("t_q")) / (c("t_n") * c("t_qq") - c("t_q") * c("t_q"))
    s = s.withColumn("s", slope).withColumn("i", (c("t_y") - c("s") * c("t_q")) / c("t_n")).withColumn("a", c("t_y") / c("t_n"))
    ssr = c("yy") - 2 * c("i") * c("y") - 2 * c("s") * c("yq") + c("n") * c("i") * c("i") + 2 * c("i") * c("s") * c("q") + c("s") * c("s") * c("qq")
    sst = c("yy") - 2 * c("a") * c("y") + c("n") * c("a") * c("a")
    return s.agg(r(1 - F.sum(ssr) / F.sum(sst), 5).alias("ev"), F.sum("n").cast("bigint").alias("n"))


@add("A46_mode_errors", f"""WITH l AS (SELECT i AS mode, embedding[i]::DOUBLE AS a, round(embedding[i]::DOUBLE, 1) AS b FROM embeddings, range(1, 9) g(i)), s AS (SELECT mode, sqrt(sum(power(a - b, 2)) / sum(a * a)) AS rel, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS corr, sum(power(a - b, 2)) AS e, sum(a * a) AS n FROM l GROUP BY mode)
SELECT CAST(mode AS INTEGER) AS mode, {R("rel", 5)} AS rel_l2, {R("corr", 5)} AS corr, {R("sqrt(sum(e) OVER (ORDER BY mode) / sum(n) OVER (ORDER BY mode))", 5)} AS cumulative FROM s""")
def a46(spark, sf):
    l = t(spark, sf, "embeddings").select(F.posexplode(F.slice("embedding", 1, 8)).alias("m", "v")).select((F.col("m") + 1).alias("mode"), F.col("v").cast("double").alias("a"))  # noqa: E741
    l = l.withColumn("b", F.round("a", 1)).withColumn("d", F.col("a") - F.col("b"))  # noqa: E741
    s = l.groupBy("mode").agg(F.sum(F.col("d") * F.col("d")).alias("e"), F.sum(F.col("a") * F.col("a")).alias("n"), x.ratio(F.covar_pop("a", "b"), F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("corr"))
    w = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("mode", r(F.sqrt(F.col("e") / F.col("n")), 5).alias("rel_l2"), r("corr", 5).alias("corr"), r(F.sqrt(F.sum("e").over(w) / F.sum("n").over(w)), 5).alias("cumulative"))


@add("A47_affine_fit", f"SELECT p_type AS channel, count(*) AS n, {R('CASE WHEN count(*) > 10 AND var_pop(l_quantity) > 0 THEN regr_slope(l_extendedprice, l_quantity) ELSE 1 END', 4)} AS slope, {R('CASE WHEN count(*) > 10 AND var_pop(l_quantity) > 0 THEN regr_intercept(l_extendedprice, l_quantity) ELSE 0 END', 2)} AS intercept FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def a47(spark, sf):
    li = t(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").select("l_partkey", "l_extendedprice", "l_quantity")
    p = t(spark, sf, "part").select("p_partkey", "p_type")
    ok = (F.count(F.lit(1)) > 10) & (F.var_pop("l_quantity") > 0)
    g = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_type").alias("channel"))
    return g.agg(F.count(F.lit(1)).alias("n"), r(F.when(ok, F.regr_slope("l_extendedprice", "l_quantity")).otherwise(1.0), 4).alias("slope"), r(F.when(ok, F.regr_intercept("l_extendedprice", "l_quantity")).otherwise(0.0), 2).alias("intercept"))


@add("A48_M2_ridge", f"SELECT l_returnflag, {R('avg(i + s * l_quantity)', 2)} AS mean_prediction FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1")
def a48(spark, sf):
    li = t(spark, sf, "lineitem")
    model = learn.Ridge(0.0).fit(li.where("l_returnflag in ('A', 'R')"), ["l_quantity"], "l_extendedprice")
    return model.predict(li).groupBy("l_returnflag").agg(r(F.avg("prediction"), 2).alias("mean_prediction"))


@add("A49_A57_parcel_table", f"WITH p AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS cx, avg(embedding[2]::DOUBLE) AS cy FROM embeddings GROUP BY 1) SELECT label AS parcel, n, {R('n * 0.000015625', 9)} AS mm3, {R('n * 1.0 / sum(n) OVER ()')} AS share, {R('cx')} AS cx, {R('cy')} AS cy FROM p")
def a57(spark, sf):
    p = t(spark, sf, "embeddings").groupBy(F.col("label").alias("parcel")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("embedding")[0].cast("double")).alias("cx"), F.avg(F.col("embedding")[1].cast("double")).alias("cy"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return p.select("parcel", "n", r(F.col("n") * 0.000015625, 9).alias("mm3"), r(share).alias("share"), r("cx").alias("cx"), r("cy").alias("cy"))


@add("A51_W13_histogram_density", "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem), k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(floor((l_quantity - a) / (b - a) * 20), 19) AS xb, least(floor((l_extendedprice - c) / (d - c) * 20), 19) AS yb FROM lineitem, s), c AS (SELECT xb, yb, count(*) AS n FROM k GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS density FROM k JOIN c USING (xb, yb)")
def a51(spark, sf):
    from ..operators.bins import histogram_density

    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return histogram_density(li, "l_quantity", "l_extendedprice", 20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "density")


@add("A52_shared_histograms", "WITH l AS (SELECT 'true' AS kind, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'pred', l_extendedprice * (1 - l_discount) FROM lineitem), s AS (SELECT min(v) AS a, max(v) AS b FROM l) SELECT kind, CAST(least(floor((v - a) / (b - a) * 60), 59) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1, 2")
def a52(spark, sf):
    from ..operators.bins import histogram

    li = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("true"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    return histogram(li.unpivot([], ["true", "pred"], "kind", "v"), ["kind"], "v", 60)


@add("A54_max_projection", f"SELECT l_suppkey % 32 AS y, l_linenumber AS z, {R('max(l_extendedprice)', 3)} AS top FROM lineitem GROUP BY 1, 2")
def a54(spark, sf):
    return t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 32).alias("y"), F.col("l_linenumber").alias("z")).agg(r(F.max("l_extendedprice"), 3).alias("top"))


@add("A58_posterior_variance", f"SELECT vec_id, {R('list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))')} AS total FROM embeddings")
def a58(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", r(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("total"))


@add("A61_weighted_std", f"WITH g AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity - 5 AS w FROM lineitem), s AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (w > 0) AS n, sum(w) FILTER (w > 0) AS w, sum(w * y) FILTER (w > 0) AS wy, sum(w * y * y) FILTER (w > 0) AS wyy FROM g GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, n, {R('CASE WHEN n >= 10 THEN sqrt(greatest(wyy / w - power(wy / w, 2), 0)) END', 2)} AS sd FROM s")
def a61(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("w", F.col("l_quantity") - 5)
    s = li.groupBy("l_returnflag", "l_linestatus").agg(*stats.weighted_std("l_extendedprice", "w"))
    return s.select("l_returnflag", "l_linestatus", "n", r(stats.finish_weighted_std(), 2).alias("sd"))


@add("A69_long_key_values", "SELECT user_id % 10 AS run, max(CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END) AS click, max(CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END) AS view FROM events GROUP BY 1")
def a69(spark, sf):
    e = t(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("run").pivot("event_type", ["click", "view"]).agg(F.max("k"))


@add("W5_W6_running_share", f"WITH s AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1), r AS (SELECT p_brand, v / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, p_brand) AS k FROM s), c AS (SELECT *, sum(share) OVER (ORDER BY k) AS run FROM r) SELECT min(CASE WHEN run >= 0.9 THEN k END) AS k90, min(CASE WHEN run >= 0.95 THEN k END) AS k95, {R('1 / sum(share * share)')} AS effective FROM c")
def w5(spark, sf):
    s = t(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    c = stats.running_share(s, [F.desc("v"), F.col("p_brand")], "v")
    first = lambda q: F.min(F.when(F.col("running") >= q, F.col("k"))).cast("bigint")
    return c.agg(first(0.9).alias("k90"), first(0.95).alias("k95"), r(1 / F.sum(F.col("share") * F.col("share"))).alias("effective"))


@add("B18_depth_blocks", "WITH q AS (SELECT quantile_cont(s_acctbal, [0.25, 0.5, 0.75]) AS e FROM supplier) SELECT s_suppkey, CAST((s_acctbal >= e[1])::INT + (s_acctbal >= e[2])::INT + (s_acctbal >= e[3])::INT AS INTEGER) AS block FROM supplier, q")
def b18(spark, sf):
    s = t(spark, sf, "supplier")
    return s.select("s_suppkey", stats.digitise("s_acctbal", stats.quantile_edges(s, "s_acctbal", 4)).alias("block"))


@add("T7_T10_picks_along_a_ranking", "WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer), w AS (SELECT CAST(floor(j * (SELECT max(n) - 1 FROM k) / 9.0) AS BIGINT) AS k FROM range(10) g(j)) SELECT c_custkey, k.k FROM k JOIN w ON w.k = k.k")
def t10(spark, sf):
    from ..operators.bins import picks_along

    return picks_along(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 10).select("c_custkey", F.col("rank").alias("k"))


@add("B15_B16_M14_centres_to_points")
def b15(spark, sf):
    return learn.centres_to_points(points(spark, sf), "id", ["x", "y", "z"], 8).select("id")


@add("M3_boosting")
def m3(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = learn.Boosting(5, 3).fit(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey").predict(li)
    return metrics.score(out, [], "l_extendedprice", "prediction").select("n", r("rmse", 0).alias("rmse"))


@add("F20_G23_soft_membership", f"""WITH c(parcel, cx, cy) AS (VALUES (0, -0.1, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1), (3, 0.0, -0.1)), d AS (SELECT vec_id, parcel, power(embedding[1]::DOUBLE - cx, 2) + power(embedding[2]::DOUBLE - cy, 2) AS d2 FROM embeddings, c),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, parcel) AS k FROM d), m AS (SELECT *, exp(-d2 / greatest(avg(d2) OVER (PARTITION BY vec_id), 1e-12)) AS e FROM k WHERE k <= 2) SELECT vec_id, parcel, {R("e / sum(e) OVER (PARTITION BY vec_id)")} AS w FROM m""")
def f20(spark, sf):
    c = spark.createDataFrame([(0, -0.1, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1), (3, 0.0, -0.1)], "parcel int, cx double, cy double")
    a, b = F.col("embedding")[0].cast("double") - F.col("cx"), F.col("embedding")[1].cast("double") - F.col("cy")
    d = t(spark, sf, "embeddings").crossJoin(F.broadcast(c)).select("vec_id", "parcel", (a * a + b * b).alias("d2"))  # four parcels
    return learn.soft_membership(d, "vec_id", "parcel", "d2", 2).select("vec_id", "parcel", r("w").alias("w"))
