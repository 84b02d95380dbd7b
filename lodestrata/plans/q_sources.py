"""Sinks and what is read back from them: caches, partitioned volumes, metric files of many runs, sets of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn, metrics
from ..sources import readers, sinks
from .registry import Catalog, R, r, t
from .shared import scratch

CATALOG = Catalog()
add = CATALOG.add


@add("K1_K8_compute_or_load", f"SELECT l_suppkey, count(*) AS n, {R('sum(l_quantity)', 3)} AS quantity FROM lineitem GROUP BY l_suppkey")
def k1(spark, sf):
    path = scratch(spark, "cache")
    compute = lambda: t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 3).alias("quantity"))
    sinks.compute_or_load(spark, path, compute)
    return sinks.compute_or_load(spark, path, lambda: compute().limit(0))  # what stands there is loaded, not computed again


@add("K3_K4_volume_by_channel", f"SELECT l_returnflag AS channel, l_linenumber AS z, l_suppkey % 16 AS y, l_partkey % 16 AS x, {R('avg(l_quantity)')} AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3, 4")
def k3(spark, sf):
    cell = [F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 16).alias("x")]
    path = scratch(spark, "volume")
    sinks.write_volume(t(spark, sf, "lineitem").groupBy(*cell).agg(r(F.avg("l_quantity")).alias("v")), path)
    return spark.read.parquet(path).where("channel <> 'N'").select("channel", "z", "y", "x", "v")  # other channels' folders are not opened


@add("S11_S12_K2_metric_files", f"SELECT l_returnflag AS run, l_linestatus AS status, count(*) AS n, {R('avg(l_discount)')} AS discount FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def s11(spark, sf):
    root = scratch(spark, "runs")
    li = t(spark, sf, "lineitem")
    reports = {f: li.where(F.col("l_returnflag") == f).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("discount")) for f in "AR"}
    sinks.write_reports(reports, root)
    runs = readers.discover_runs(spark, [root])
    rows = readers.metric_files(spark, f"{root}/*/*.csv", "status string, n long, discount double").withColumn("run", F.element_at(F.split("path", "/"), -2))
    return rows.join(runs.select("run"), "run", "left_semi").select("run", "status", "n", r("discount").alias("discount"))


@add("K5_same_sets", """SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) + (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS orders_have_lines,
(SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) + (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS customers_have_orders, (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) + (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS nations_fill_regions""")
def k5(spark, sf):
    keys = lambda name, column: t(spark, sf, name).select(F.col(column).alias("k"))
    pairs = [(keys("lineitem", "l_orderkey"), keys("orders", "o_orderkey")), (keys("orders", "o_custkey"), keys("customer", "c_custkey")), (keys("nation", "n_regionkey"), keys("region", "r_regionkey"))]
    same = [sinks.same_set(a, b, "k") for a, b in pairs]
    return spark.range(1).select(F.lit(same[0]).alias("orders_have_lines"), F.lit(same[1]).alias("customers_have_orders"), F.lit(same[2]).alias("nations_fill_regions"))


@add("U1_learners", f"""WITH a AS (SELECT count(*) AS n, stddev_pop(l_extendedprice) AS s, corr(l_extendedprice, l_quantity) AS c FROM lineitem)
SELECT 'mean' AS learner, n, {R("s", 3)} AS rmse FROM a UNION ALL SELECT 'ridge', n, {R("s * sqrt(1 - c * c)", 3)} FROM a""")
def u1(spark, sf):
    """Learners by their registered names under one contract, fitted to all rows and scored on them."""
    li, out = t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), []
    for name, model in (("mean", learn.REGISTRY["mean"]()), ("ridge", learn.REGISTRY["ridge"](0.0))):
        scored = metrics.score(model.fit(li, ["l_quantity"], "l_extendedprice").predict(li), [], "l_extendedprice", "prediction")
        out.append(scored.select(F.lit(name).alias("learner"), "n", r("rmse", 3).alias("rmse")))
    return out[0].unionByName(out[1])
