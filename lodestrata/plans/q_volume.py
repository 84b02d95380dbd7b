"""Volumes, kernel features, factor kernels, smoothing and further learners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import graph as g
from ..operators import convolution, enhance, experts, grouped, guard, learn, metrics, sampling, sparse_gp, spatial, transport, volume
from .q_graph import BW, EDGES, LAP, POINTS, SYM, edges, points, vectors
from .registry import Catalog, R, i, r, t
from .shared import cut

CATALOG = Catalog()
add = CATALOG.add
NODES = "v AS (SELECT l_linenumber AS z, CAST(l_suppkey % 16 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT (z * 16 + y) * 16 + x AS id, * FROM v)"


def voxels(spark, sf):
    v = t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"))
    return cut(v.withColumn("id", (F.col("z") * 16 + F.col("y")) * 16 + F.col("x")), "voxels")


@add("G21_surface_depth", f"""WITH {NODES}, o(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), rim AS (SELECT DISTINCT z + a AS z, y + b AS y, x + c AS x FROM n, o EXCEPT SELECT z, y, x FROM n)
SELECT n.id, {R("sqrt(min(power(n.z - rim.z, 2) + power(n.y - rim.y, 2) + power(n.x - rim.x, 2)))")} AS depth FROM n, rim GROUP BY n.id""")
def g21(spark, sf):
    return volume.surface_depth(voxels(spark, sf), "id").select("id", r("depth").alias("depth"))


@add("G21_hole_filling", f"""WITH RECURSIVE {NODES}, b AS (SELECT min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM n),
f AS (SELECT z, y, x, z IN (z0, z1) OR y IN (y0, y1) OR x IN (x0, x1) AS side FROM b, range(0, 8) a(z), range(0, 16) c(y), range(0, 16) d(x) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.z = a.z AND n.y = c.y AND n.x = d.x)),
o(z, y, x) AS (SELECT z, y, x FROM f WHERE side UNION SELECT f.z, f.y, f.x FROM f JOIN o ON abs(f.z - o.z) + abs(f.y - o.y) + abs(f.x - o.x) = 1)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n) + (SELECT count(*) FROM f) - (SELECT count(*) FROM o) AS n_filled""")
def g21b(spark, sf):
    v = voxels(spark, sf)
    return v.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(volume.fill_holes(v).agg(F.count(F.lit(1)).alias("n_filled"))))


_W = dict(volume.gaussian_weights(1.0, 2.0))
_WV = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in _W.items())


@add("G22_gaussian_smoothing", f"""WITH {NODES}, w(d, w) AS (VALUES {_WV}) SELECT a.id, {R("sum(b.v * wz.w * wy.w * wx.w) / sum(wz.w * wy.w * wx.w)")} AS v
FROM n a JOIN n b ON abs(a.z - b.z) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 JOIN w wz ON wz.d = a.z - b.z JOIN w wy ON wy.d = a.y - b.y JOIN w wx ON wx.d = a.x - b.x GROUP BY a.id""")
def g22(spark, sf):
    v = voxels(spark, sf)
    return volume.smooth(v, "v", 1.0, 2.0).select(((F.col("z") * 16 + F.col("y")) * 16 + F.col("x")).alias("id"), r("v").alias("v"))


@add("G22_gradient_size", f"""WITH {NODES}, s AS (SELECT c.id, c.v, (SELECT v FROM n WHERE n.z = c.z + 1 AND n.y = c.y AND n.x = c.x) AS a, (SELECT v FROM n WHERE n.z = c.z - 1 AND n.y = c.y AND n.x = c.x) AS b,
(SELECT v FROM n WHERE n.z = c.z AND n.y = c.y + 1 AND n.x = c.x) AS d, (SELECT v FROM n WHERE n.z = c.z AND n.y = c.y - 1 AND n.x = c.x) AS e, (SELECT v FROM n WHERE n.z = c.z AND n.y = c.y AND n.x = c.x + 1) AS f, (SELECT v FROM n WHERE n.z = c.z AND n.y = c.y AND n.x = c.x - 1) AS g FROM n c)
SELECT id, {R("sqrt(power((coalesce(a, v) - coalesce(b, v)) / 2, 2) + power((coalesce(d, v) - coalesce(e, v)) / 2, 2) + power((coalesce(f, v) - coalesce(g, v)) / 2, 2))")} AS gradient FROM s""")
def g22b(spark, sf):
    return volume.gradient_size(voxels(spark, sf), "v").select(((F.col("z") * 16 + F.col("y")) * 16 + F.col("x")).alias("id"), r("gradient").alias("gradient"))


@add("G22_hessian_and_deviation")
def g22c(spark, sf):
    v = voxels(spark, sf)
    h = volume.hessian_eigenvalues(v, "v").join(volume.local_deviation(v, "v", 1.0), volume.AXES)
    return h.select(*volume.AXES, *[r(f"e{k}").alias(f"e{k}") for k in range(3)], r("deviation").alias("deviation"))


_SCALE = " + ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * CAST(embedding[{k + 1}] AS DOUBLE) * power(2 * 1.5 / 0.25 + {k / 8.0}, -1.5)" for k in range(8))


@add("G12_kernel_features", f"SELECT vec_id, {R(_SCALE, 8)} AS diagonal FROM embeddings")
def g12(spark, sf):
    lam = F.array(*[F.lit(k / 8.0) for k in range(8)])
    phi = F.zip_with(F.slice("embedding", 1, 8), lam, lambda p, m: p.cast("double") * F.sqrt(x.spectral_density(m, 0.5, 1.5)))
    return t(spark, sf, "embeddings").select("vec_id", phi.alias("f")).select("vec_id", r(x.dot("f", "f"), 8).alias("diagonal"))


@add("G14_precision_operator", f"""WITH {LAP}, v AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x FROM embeddings), y AS (
  SELECT d.node, max(m.x) AS x, ((1 - 1 / (d.q * d.q * d.degree)) * max(m.x) - sum(a.w / sqrt(d.degree * o.degree) * v.x)) / ({BW} * {BW}) AS y
  FROM d JOIN v m ON m.node = d.node JOIN a ON a.src = d.node JOIN d o ON o.node = a.dst JOIN v ON v.node = a.dst GROUP BY d.node, d.q, d.degree)
SELECT node, {R("2 / 0.25 * x + y", 5)} AS y FROM y""")
def g14(spark, sf):
    entries = g.laplacian_entries(g.laplacian(edges(spark, sf), BW), BW)
    vec = t(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("x"))
    return g.precision_matvec(entries, vec, 0.5, 1).select("node", r("y", 5).alias("y"))


#: Pairs of suppliers that one task makes.
PAIRS = 1 << 24


@add("G15_factor_kernels", f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, {R('exp(-power(a.s_acctbal - b.s_acctbal, 2) / (2 * 1000000.0)) * CASE WHEN a.s_nationkey = b.s_nationkey THEN 1 ELSE 0.3 END')} AS k FROM supplier a, supplier b")
def g15(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    d = F.col("d1") - F.col("s_acctbal")
    k = x.gaussian(d * d, 1000.0) * F.when(F.col("p1") == F.col("s_nationkey"), 1.0).otherwise(0.3)
    # the table is one small file, which alone would make all pairs in one task; and round() goes through decimals, pair by pair
    n = s.count()
    rows = s.toDF("a", "d1", "p1").repartition(max(1, min(n, -(-n * n // PAIRS))), "a")
    return rows.crossJoin(F.broadcast(s)).select("a", F.col("s_suppkey").alias("b"), (F.floor(k * 1e6 + 0.5) / 1e6).alias("k"))


@add("G28_index_size", "SELECT count(*) AS n, CAST(greatest(1, floor(sqrt(count(*)))) AS INTEGER) AS lists FROM embeddings")
def g28(spark, sf):
    return t(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).withColumn("lists", F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int"))


@add("G29_section_envelope")
def g29(spark, sf):
    import pandas as pd

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("x")
        return f.assign(e=grouped.envelope(f["v"].to_numpy(float) - f["v"].mean()))[["y", "x", "e"]]

    v = t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.avg("l_quantity").alias("v"))
    return grouped.per_channel(v, "y", fit, "y long, x long, e double").select("y", "x", r("e", 5).alias("e"))


@add("G30_error_slice", f"""WITH k AS (SELECT l_linenumber AS plane, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, plane LIMIT 1), e AS (SELECT l_extendedprice * (1 - l_discount) - l_extendedprice AS e FROM lineitem JOIN k ON l_linenumber = plane)
SELECT count(*) AS n, {R("avg(e)", 3)} AS bias, {R("sqrt(avg(e * e))", 3)} AS rmse, {R("quantile_cont(abs(e), 0.99)", 3)} AS p99 FROM e""")
def g30(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("plane"), (-F.col("l_extendedprice") * F.col("l_discount")).alias("e"))
    plane = li.groupBy("plane").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "plane").limit(1).select("plane")
    e = li.join(F.broadcast(plane), "plane", "left_semi")
    return e.agg(F.count(F.lit(1)).alias("n"), r(F.avg("e"), 3).alias("bias"), r(F.sqrt(F.avg(F.col("e") * F.col("e"))), 3).alias("rmse"), r(F.percentile(F.abs("e"), F.lit(0.99)), 3).alias("p99"))


@add("G32_spectral_smoothing", f"SELECT CAST(k AS INTEGER) AS mode, {R('sum(embedding[k]::DOUBLE * label)', 4)} AS coefficient, {R('sum(embedding[k]::DOUBLE * label) * power(12 + k / 8.0, -1.5) / (power(12 + k / 8.0, -1.5) + 0.01)', 4)} AS smoothed FROM embeddings, range(1, 9) g(k) GROUP BY k")
def g32(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 8)).alias("m", "phi"))
    c = e.groupBy((F.col("m") + 1).alias("mode")).agg(F.sum(F.col("phi").cast("double") * F.col("label")).alias("c"))
    s = F.pow(12 + F.col("mode") / 8.0, F.lit(-1.5))
    return c.select("mode", r("c", 4).alias("coefficient"), r(F.col("c") * s / (s + 0.01), 4).alias("smoothed"))


@add("G33_M10_M16_U5_gp_by_channel")
def g33(spark, sf):
    p = points(spark, sf).select("label", "id", "x", "y", F.col("z").alias("target"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    return grouped.gp_by_channel(p, "label", ["x", "y"], "target", "split", "id", 0.2).select("label", "id", r("prediction", 5).alias("prediction"), "noise")


@add("B17_blended_sample", """WITH w AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY -ln(CAST('0x' || substr(md5('8:' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0 + 1e-12) / c_acctbal, c_custkey LIMIT 40),
c AS (SELECT c_custkey FROM customer ORDER BY abs(c_acctbal - 5000), c_custkey LIMIT 50), s AS (SELECT c_custkey FROM c ORDER BY md5('9:' || c_custkey), c_custkey LIMIT 10) SELECT c_custkey FROM w UNION SELECT c_custkey FROM s""")
def b17(spark, sf):
    c = t(spark, sf, "customer")
    dense = sampling.weighted_sample(c, "c_acctbal", 40, 8, "c_custkey").select("c_custkey")
    cheap = c.orderBy(F.abs(F.col("c_acctbal") - 5000), "c_custkey").limit(50)
    return dense.unionByName(sampling.sample(cheap, 10, 9, "c_custkey").select("c_custkey")).distinct()


@add("M5_perceptron")
def m5(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    model = learn.Perceptron(8, 60, 2000).fit(li, ["l_quantity", "l_discount"], "l_extendedprice", "l_orderkey")
    return metrics.score(model.predict(li), [], "l_extendedprice", "prediction").select("n", r("rmse", -2).alias("rmse"))


@add("M6_graph_convolution", f"""WITH {LAP}, v AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x FROM embeddings)
SELECT d.node, {R("(sum(a.w * v.x) + max(m.x) / (d.q * d.q)) / d.degree")} AS x FROM d JOIN v m ON m.node = d.node JOIN a ON a.src = d.node JOIN v ON v.node = a.dst GROUP BY d.node, d.q, d.degree""")
def m6(spark, sf):
    parts = g.laplacian(cut(edges(spark, sf), "edges"), BW)
    f = vectors(spark, sf).select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("x"))
    return learn.GraphConvolution(parts, 1).smooth(f, ["x"]).select("node", r("x").alias("x"))


@add("M11_factor_posterior", f"""WITH {POINTS}, a AS (SELECT 1 + sum(x * x) / 0.1 AS a, sum(x * y) / 0.1 AS b, 1 + sum(y * y) / 0.1 AS c, sum(x * z) / 0.1 AS p, sum(y * z) / 0.1 AS q FROM p)
SELECT 0 AS factor, {R("(c * p - b * q) / (a * c - b * b)", 5)} AS mean, {R("c / (a * c - b * b)")} AS variance FROM a
UNION ALL SELECT 1, {R("(a * q - b * p) / (a * c - b * b)", 5)}, {R("a / (a * c - b * b)")} FROM a""")
def m11(spark, sf):
    p = points(spark, sf)
    mean, cov = learn.factor_posterior(p, ["x", "y"], ["z"], 0.1)
    return spark.createDataFrame([(k, round(float(mean[k, 0]), 5), round(float(cov[k, k]), 6)) for k in range(2)], "factor int, mean double, variance double")


@add("M7_interpolation_preparation", f"""WITH a AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, CASE WHEN min(l_discount) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN l_discount > 0 THEN l_discount END))) END AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT max(v) AS top FROM a)
SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS n_rows, {R("avg(v / nullif(top, 0) * 255)", 4)} AS mean_scaled FROM a, s""")
def m7(spark, sf):
    from ..operators.stats import geometric_mean

    a = t(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y")).agg(geometric_mean("l_discount").alias("v"), F.count(F.lit(1)).alias("n"))
    top = F.max("v").over(Window.partitionBy(F.lit(1)))
    return a.withColumn("s", F.col("v") / F.nullif(top, F.lit(0.0)) * 255).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n_rows"), r(F.avg("s"), 4).alias("mean_scaled"))


@add("M8_mixture_of_experts", f"""WITH p AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS p, [embedding[4]::DOUBLE * 8, embedding[5]::DOUBLE * 8, embedding[6]::DOUBLE * 8] AS g FROM embeddings),
e AS (SELECT vec_id, p, list_transform(g, lambda v: exp(v - list_max(g))) AS e FROM p) SELECT vec_id, {R("(p[1] * e[1] + p[2] * e[2] + p[3] * e[3]) / list_sum(e)")} AS y FROM e""")
def m8(spark, sf):
    v = lambda a, b, s: F.array(*[F.col("embedding")[k].cast("double") * s for k in range(a, b)])
    e = t(spark, sf, "embeddings").select("vec_id", v(0, 3, 1.0).alias("p"), v(3, 6, 8.0).alias("g"))
    return e.select("vec_id", r(x.mixture("p", "g")).alias("y"))


@add("M9_M18_spectral_regression", f"""WITH d AS (SELECT vec_id, embedding[1]::DOUBLE AS f, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT 1 / (sum(f * f) / 0.5 + 1 / 2.0) AS c, sum(f * y) / 0.5 AS b FROM d)
SELECT vec_id, {R("c * b * f")} AS mean, {R("0.5 + c * f * f")} AS variance FROM d, s""")
def m9(spark, sf):
    d = t(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("f"), F.col("embedding")[1].cast("double").alias("y"))
    out = learn.SpectralRegression([2.0], 0.5).fit(d, ["f"], "y").predict(d, "mean", "variance")
    return out.select("vec_id", r("mean").alias("mean"), r("variance").alias("variance"))


@add("M12_hash_field")
def m12(spark, sf):
    p = points(spark, sf).select("id", *[(F.col(c) + 0.5).alias(c) for c in "xyz"], (F.col("x") * 2 - F.col("y")).alias("target"))
    model = learn.HashField((4, 8), 512, 4).fit(p, "id", ["x", "y", "z"], "target")
    return metrics.score(model.predict(p), [], "target", "prediction").select("n", r("rmse", 2).alias("rmse"))


STEPS = 60


@add("M12_section_transport", f"""WITH RECURSIVE p AS (SELECT c_nationkey AS s, c_custkey AS id, c_acctbal / 5000 AS x, (c_custkey % 53) / 25.0 AS y, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
w(step, s, i, j, c, na, nb, u, v) AS (
  SELECT 0, a.s, a.id, b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2.0, a.n, b.n, 0.0::DOUBLE, 0.0::DOUBLE FROM p a JOIN p b ON b.s = a.s + 1
  UNION ALL SELECT step + 1, s, i, j, c, na, nb, u, -ln(sum(exp(u - c) / na) OVER (PARTITION BY s, j)) FROM (
    SELECT step, s, i, j, c, na, nb, -ln(sum(exp(v - c) / nb) OVER (PARTITION BY s, i)) AS u FROM w WHERE step < {STEPS})),
m AS (SELECT w.s, i, sum(exp(u + v - c) / na / nb) AS mass, sum(exp(u + v - c) / na / nb * c) * 2.0 AS cost, sum(exp(u + v - c) / na / nb * x) AS y0, sum(exp(u + v - c) / na / nb * y) AS y1
  FROM w JOIN p ON p.id = j WHERE step = {STEPS} GROUP BY w.s, i)
SELECT s AS section, i AS id, {R("cost * 1000", 3)} AS cost, {R("y0 / mass", 4)} AS x, {R("y1 / mass", 4)} AS y FROM m""")
def m12_transport(spark, sf):
    """Every customer's place in the next nation's section, under the plans between all neighbouring sections."""
    p = t(spark, sf, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 5000).alias("x"), ((F.col("c_custkey") % 53) / 25.0).alias("y"))
    pairs = p.select(F.col("c_nationkey").alias("a")).distinct().select("a", (F.col("a") + 1).alias("b"))
    solved = transport.Transport(p, "c_nationkey", "c_custkey", ["x", "y"], pairs, 2.0, tolerance=1e-9).carried()
    return solved.select(F.col("a").alias("section"), F.col("key").alias("id"), r(F.col("cost") * 1000, 3).alias("cost"), r("y0", 4).alias("x"), r("y1", 4).alias("y"))


@add("G29_pattern_enhancement")
def g29_patterns(spark, sf):
    """Every order's two channels in the images of its section, enhanced in both ways."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", F.dayofyear("o_orderdate").cast("double").alias("a"), (F.col("o_orderkey") % 101).cast("double").alias("b"))
    shown = lambda mode: enhance.enhance(o, "o_orderpriority", "o_totalprice", "o_custkey", ["a", "b"], 64, mode).select("o_orderkey", F.lit(mode).alias("mode"), r("a", 5).alias("a"), r("b", 5).alias("b"))
    return shown("envelope").unionByName(shown("anti-leakage"))


@add("K16_bad_row_guard", """WITH b AS (SELECT l_linenumber AS batch, count(*) AS n, count(*) FILTER (l_discount = 0) AS bad FROM lineitem GROUP BY 1),
g AS (SELECT *, bad > 0.09 * n AS fails, sum(CASE WHEN bad > 0.09 * n THEN 0 ELSE 1 END) OVER (ORDER BY batch) AS run FROM b)
SELECT batch, n, bad, CASE WHEN fails THEN sum(CASE WHEN fails THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY batch) ELSE 0 END AS streak FROM g""")
def k16(spark, sf):
    """Line items batch by batch; rows whose logarithm of the discount is missing are bad, and batches with more than 9 % of them."""
    li = t(spark, sf, "lineitem").select("l_linenumber", F.ln("l_discount").alias("v"))
    watch, rows = guard.Guard(["v"], share=0.09), []
    for (batch,) in sorted(li.select("l_linenumber").distinct().collect()):  # seven batches
        watch.watch(li.where(F.col("l_linenumber") == batch)).write.format("noop").mode("overwrite").save()
        seen = watch.settle()
        rows.append((batch, seen["n"], seen["bad"], seen["streak"]))
    return spark.createDataFrame(rows, "batch long, n long, bad long, streak long")


@add("M17_sparse_tasks")
def m17(spark, sf):
    """Two tasks over three coordinates with 64 inducing points drawn by hash; every row's posterior."""
    p = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(["x", "y", "z", "a", "b"])])
    inducing = [tuple(row) for row in p.orderBy(x.portable_hash(0, "id"), "id").select("x", "y", "z").limit(64).collect()]
    model = sparse_gp.SparseTasks(inducing, [0.2, 0.2, 0.4], [0.02, 0.02], [0.01, 0.01]).fit(p, ["x", "y", "z"], ["a", "b"])
    return model.predict(p, "id").select("id", "task", r("mean", 5).alias("mean"), r("variance", 5).alias("variance"))


@add("M8_fitted_experts")
def m8_fitted(spark, sf):
    """Four experts for the price of an order, fitted to all orders; every order's prediction."""
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("a"), (F.dayofyear("o_orderdate") / 100).alias("b"), (F.col("o_totalprice") / 100000).alias("y"))
    return experts.MixtureOfExperts(4, rounds=8).fit(o, ["a", "b"], "y").predict(o).select("o_orderkey", r("prediction", 4).alias("prediction"))


@add("M6_trained_convolution")
def m6_trained(spark, sf):
    """Read out at every vector from its three nearest others, trained on four fifths of them."""
    v = t(spark, sf, "embeddings").select("vec_id", "embedding", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)])
    near = cut(spatial.vector_knn(v, v, "vec_id", "embedding", 3).select("src", "dst", "d2"), "near")
    model = convolution.TrainedConvolution(4, rounds=6).prepare(v, "vec_id", ["e0", "e1", "e2"], cut(edges(spark, sf), "edges"), near)
    return model.fit(v.where("vec_id % 5 <> 0"), "vec_id", "e3").predict().select(F.col("i").alias("vec_id"), r("prediction", 4).alias("prediction"))


@add("M9_many_modes")
def m9_many(spark, sf):
    """Sixty-three modes at once: the last component of every vector from all others, with its variance."""
    v = t(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])
    names = [f"e{k}" for k in range(63)]
    made = learn.SpectralRegression([1.0 / (1 + k) for k in range(63)], 0.05).fit(v, names, "e63").predict(v, "mean", "variance")
    return made.select("vec_id", r("mean", 5).alias("mean"), r("variance").alias("variance"))
