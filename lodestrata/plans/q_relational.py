"""Scans, filters, scalar functions, joins, sorts, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import sampling
from ..sources import readers, sinks
from .registry import Catalog, R, i, r, t

CATALOG = Catalog()
add = CATALOG.add
TRAIN = [("l_returnflag", "==", "A"), ("l_returnflag", "==", "R")]


@add("S1_S2_P1_dnf_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity >= 45) OR (l_returnflag = 'R' AND l_linestatus NOT IN ('O'))")
def s1(spark, sf):
    return readers.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], [[("l_returnflag", "==", "A"), ("l_quantity", ">=", 45)], [("l_returnflag", "==", "R"), ("l_linestatus", "not in", ["O"])]])


@add("P2_P21_and_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity < 10")
def p2(spark, sf):
    groups = readers.and_in(readers.parse_dnf('[["l_returnflag", "==", "A"], ["l_returnflag", "==", "R"]]'), "l_linestatus", ["F"])
    return t(spark, sf, "lineitem").where(readers.dnf(groups) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber")


@add(
    "S3_B4_S14_split_loader",
    f"""SELECT CASE WHEN l_linestatus <> 'X' AND l_returnflag = 'N' THEN 'test' ELSE 'train' END AS split, count(*) AS n, {R("avg(ln(l_extendedprice + 1e-10))", 5)} AS log_mean, {R("avg(l_extendedprice)", 3)} AS raw_mean FROM lineitem GROUP BY 1""",
)
def s3(spark, sf):
    split = readers.split_column({"train": TRAIN, "test": [("l_returnflag", "==", "N")], "ignore": [("l_linestatus", "==", "X")]})
    df = t(spark, sf, "lineitem").select(split, "l_extendedprice")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r(F.avg(x.log_eps("l_extendedprice")), 5).alias("log_mean"), r(F.avg("l_extendedprice"), 3).alias("raw_mean"))


@add(
    "S4_W4_A56_whole_sections",
    """WITH c AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS section, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, section ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT section, n FROM s WHERE run <= (SELECT count(*) // 10 FROM lineitem) OR run = n""",
)
def s4(spark, sf):
    li = t(spark, sf, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("section"))
    cap = li.count() // 10
    return readers.whole_sections(li, "section", [F.desc("_n")], cap).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@add("S5_B1_excluding_sample", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100")
def s5(spark, sf):
    return readers.excluding(t(spark, sf, "orders"), "o_orderpriority", ["1-URGENT"], 100, 3, "o_orderkey").select("o_orderkey", "o_orderpriority")


@add(
    "S6_D13_section_table",
    f"""SELECT user_id, CAST(ts AS DATE) AS section, count(*) AS n, {R("avg(value)", 5)} AS depth, min(event_type) AS region FROM events GROUP BY 1, 2""",
)
def s6(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("section")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 5).alias("depth"), F.min("event_type").alias("region"))


@add("S7_R4_distinct_rounded", "SELECT DISTINCT CAST(round_even(l_extendedprice / 1000, 0) AS BIGINT) AS a, CAST(round_even(l_quantity / 5, 0) AS BIGINT) AS b FROM lineitem")
def s7(spark, sf):
    return t(spark, sf, "lineitem").select(i(F.bround(F.col("l_extendedprice") / 1000)).alias("a"), i(F.bround(F.col("l_quantity") / 5)).alias("b")).distinct()


@add("S9_schema", "SELECT * FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) AS v(position, name, type)")
def s9(spark, sf):
    return readers.schema_table(t(spark, sf, "nation"))


@add("S10_listing", "SELECT DISTINCT c_mktsegment FROM customer")
def s10(spark, sf):
    return t(spark, sf, "customer").select("c_mktsegment").distinct()


@add("S15_P8_P6_stride", "SELECT l_partkey // 4 AS z, l_suppkey // 2 AS y, count(*) AS n FROM lineitem WHERE l_partkey % 4 = 0 AND l_suppkey % 2 = 0 AND l_quantity > 5 GROUP BY 1, 2")
def s15(spark, sf):
    li = t(spark, sf, "lineitem").where("l_partkey % 4 = 0 and l_suppkey % 2 = 0 and l_quantity > 5")
    return li.groupBy(F.expr("l_partkey div 4").alias("z"), F.expr("l_suppkey div 2").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "S16_coarsen_labels",
    """SELECT r_name AS ancestor, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def s16(spark, sf):
    n, reg = t(spark, sf, "nation"), t(spark, sf, "region")
    tree = n.join(reg, n["n_regionkey"] == reg["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("id"), F.array(F.lit("world"), "r_name", "n_name").alias("path"))
    labels = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("region"))
    return readers.coarsen(labels, F.broadcast(tree), 1).groupBy(F.col("region").alias("ancestor")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "S19_J27_J28_second_modality",
    f"""SELECT lang, source, count(*) AS n, {R("avg(quality)")} AS quality, {R("avg(n_chars)", 3)} AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""",
)
def s19(spark, sf):
    d, lab = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), t(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), r(F.avg("quality")).alias("quality"), r(F.avg("n_chars"), 3).alias("chars"))


@add("P3_P4_P5_channels", "SELECT 'l_quantity' AS channel, count(l_quantity) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem")
def p5(spark, sf):
    li = t(spark, sf, "lineitem")
    named = readers.channel_columns(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"])
    chosen = readers.resolve_channels(named, [0, "TAX"], strict=True)
    return li.select(*chosen).unpivot([], chosen, "channel", "v").groupBy("channel").agg(F.count("v").alias("n"))


@add("P7_P10_P17_box_crop", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey BETWEEN 3 AND 20 AND s_nationkey > 0 AND s_nationkey <> 7")
def p7(spark, sf):
    return t(spark, sf, "supplier").where(F.col("s_acctbal").between(0, 5000) & F.col("s_nationkey").between(3, 20) & (F.col("s_nationkey") > 0) & (F.col("s_nationkey") != 7)).select("s_suppkey", "s_nationkey")


@add("P9_render_mask", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 4) OR l_partkey % 16 IN (0, 8) OR (l_linenumber % 2 = 0 AND l_partkey % 2 = 0 AND l_suppkey % 2 = 0)")
def p9(spark, sf):
    planes = F.col("l_linenumber").isin(1, 4) | (F.col("l_partkey") % 16).isin(0, 8)
    lattice = (F.col("l_linenumber") % 2 == 0) & (F.col("l_partkey") % 2 == 0) & (F.col("l_suppkey") % 2 == 0)
    return t(spark, sf, "lineitem").where(planes | lattice).agg(F.count(F.lit(1)).alias("n"))


@add("P11_P12_P13_finite_rows", f"""SELECT event_type, count(*) AS n, count(*) FILTER (value > 0) AS n_positive, {R("avg(ln(value)) FILTER (value > 0)")} AS log_mean FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1""")
def p11(spark, sf):
    e = t(spark, sf, "events").where(x.all_finite("value"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("n_positive"), r(F.avg(F.when(F.col("value") > 0, F.ln("value")))).alias("log_mean"))


@add("P19_config_grid", """SELECT DISTINCT metric || '-' || CASE WHEN metric = 'N' THEN 'all' ELSE CAST(m AS VARCHAR) END || '-' || s AS slug
FROM (SELECT DISTINCT l_returnflag AS metric FROM lineitem), (SELECT DISTINCT l_linenumber AS m FROM lineitem), (SELECT DISTINCT l_linestatus AS s FROM lineitem)""")
def p19(spark, sf):
    li = t(spark, sf, "lineitem")
    a, b, c = (li.select(F.col(column).alias(name)).distinct() for column, name in (("l_returnflag", "metric"), ("l_linenumber", "m"), ("l_linestatus", "s")))
    grid = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # options: a handful of values each
    m = F.when(F.col("metric") == "N", F.lit("all")).otherwise(F.col("m").cast("string"))
    return grid.select(F.concat_ws("-", "metric", m, "s").alias("slug")).distinct()


@add(
    "P20_train_range_scaling",
    f"""WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS w FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT l_returnflag, {R("avg((l_quantity - a) / nullif(w, 0))")} AS mean, {R("max((l_quantity - a) / nullif(w, 0))")} AS top FROM lineitem, s GROUP BY 1""",
)
def p20(spark, sf):
    from ..operators.clean import range_stats, scale_range

    li = t(spark, sf, "lineitem")
    out = scale_range(li, range_stats(li.where(readers.dnf(TRAIN)), ["l_quantity"]), ["l_quantity"])
    return out.groupBy("l_returnflag").agg(r(F.avg("l_quantity")).alias("mean"), r(F.max("l_quantity")).alias("top"))


@add("F1_F2_F3_logs", f"SELECT event_type, {R('avg(ln(greatest(value, 0) + 1e-10))', 5)} AS a, {R('avg(ln(1 + greatest(value, 0)))')} AS b, {R('avg(exp(ln(greatest(value, 0) + 1e-10)) - 1e-10)', 5)} AS c FROM events GROUP BY 1")
def f1(spark, sf):
    v = x.clip_low("value")
    return t(spark, sf, "events").groupBy("event_type").agg(r(F.avg(x.log_eps(v)), 5).alias("a"), r(F.avg(x.log1p_clipped("value"))).alias("b"), r(F.avg(x.exp_eps(x.log_eps(v))), 5).alias("c"))


@add(
    "F4_A4_zscore_train",
    f"""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT l_returnflag, {R("avg((l_extendedprice - m) / d)")} AS z_mean, {R("stddev_pop((l_extendedprice - m) / d)")} AS z_sd, {R("avg((l_extendedprice - m) / d * d + m)", 3)} AS back FROM lineitem, s GROUP BY 1""",
)
def f4(spark, sf):
    from ..operators.clean import ZScore

    li = t(spark, sf, "lineitem")
    z = ZScore.fit(li.where(readers.dnf(TRAIN)), ["l_extendedprice"])
    out = z.transform(li)
    back = z.inverse(out.withColumn("z", F.col("l_extendedprice")))
    return back.groupBy("l_returnflag").agg(r(F.avg("z")).alias("z_mean"), r(F.stddev_pop("z")).alias("z_sd"), r(F.avg("l_extendedprice"), 3).alias("back"))


@add(
    "F5_coordinate_standardisation",
    f"""WITH c AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM c), p AS (SELECT stddev_pop(v) AS sd FROM (SELECT unnest([a, b, c]) AS v FROM c))
SELECT {R("avg((a - ma) / sd)")} AS a, {R("stddev_pop((a - ma) / sd)")} AS sa, {R("stddev_pop((b - mb) / sd)")} AS sb, {R("stddev_pop((c - mc) / sd)")} AS sc, {R("max(sd)")} AS scale FROM c, s, p""",
)
def f5(spark, sf):
    from ..operators.clean import standardise_coordinates

    e = t(spark, sf, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("abc")])
    out = standardise_coordinates(e, ["a", "b", "c"])
    return out.agg(r(F.avg("a")).alias("a"), *[r(F.stddev_pop(c)).alias(f"s{c}") for c in "abc"], r(F.max("_scale")).alias("scale"))


@add("F6_voxel_maps", "SELECT CAST(round_even(s_acctbal / 25, 0) AS BIGINT) AS nearest, CAST(trunc(s_acctbal * 10) AS BIGINT) - 1 AS cut, CAST(floor(s_acctbal / 40) AS BIGINT) AS cell, s_suppkey FROM supplier")
def f6(spark, sf):
    c = F.col("s_acctbal")
    return t(spark, sf, "supplier").select(i(F.bround(c / 25)).alias("nearest"), (i(c * 10) - 1).alias("cut"), i(F.floor(c / 40)).alias("cell"), "s_suppkey")


@add("F7_F8_F35_keys_and_hash", "WITH k AS (SELECT *, (l_partkey % 32 * 32 + l_suppkey % 32) * 8 + l_linenumber AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k, k // 256 AS a, k // 8 % 32 AS b, k % 8 AS c, xor(xor(l_partkey * 1, l_suppkey * 2654435761), CAST(l_linenumber AS BIGINT) * 805459861) % 4096 AS h FROM k WHERE l_quantity = 7")
def f7(spark, sf):
    li = t(spark, sf, "lineitem").where("l_quantity = 7")
    li = li.withColumn("k", x.flat_key(F.col("l_partkey") % 32, F.col("l_suppkey") % 32, F.col("l_linenumber"), 32, 8))
    a, b, c = x.unflat("k", 32, 8)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "k", a.alias("a"), b.alias("b"), c.alias("c"), x.spatial_hash(["l_partkey", "l_suppkey", "l_linenumber"], [1, 2654435761, 805459861], 4096).alias("h"))


@add(
    "F9_W12_minmax_255",
    f"""WITH g AS (SELECT c_nationkey, c_custkey, c_acctbal, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_nationkey))
SELECT c_custkey, {R("coalesce((c_acctbal - lo) / nullif(hi - lo, 0) * 255, 0)", 5)} AS v FROM g""",
)
def f9(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    span = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.join(span, "c_nationkey").select("c_custkey", r(x.minmax_255("c_acctbal", "lo", "hi"), 5).alias("v"))


@add(
    "F10_F11_A55_robust_unit",
    f"""WITH s AS (SELECT quantile_cont(p_retailprice, 0.02) AS a, quantile_cont(p_retailprice, 0.98) AS b FROM part)
SELECT p_type, {R("avg(least(greatest((p_retailprice - a) / (b - a), 0), 1))")} AS unit, {R("avg(power(least(greatest((p_retailprice - a) / (b - a), 0), 1), 0.5))")} AS gamma FROM part, s GROUP BY 1""",
)
def f10(spark, sf):
    p = t(spark, sf, "part").select("p_type", "p_retailprice")
    s = p.agg(F.percentile("p_retailprice", F.array(F.lit(0.02), F.lit(0.98))).alias("q"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    unit = x.robust_unit("p_retailprice", F.col("q")[0], F.col("q")[1], "lo", "hi")
    return p.crossJoin(F.broadcast(s)).groupBy("p_type").agg(r(F.avg(unit)).alias("unit"), r(F.avg(x.gamma_colour(unit, 0.5))).alias("gamma"))


@add(
    "F12_F13_F14_F15_F16_kernels",
    f"""WITH d AS (SELECT o_orderkey, o_totalprice / 125000 AS d FROM orders)
SELECT o_orderkey, {R("exp(-d * d / (4 * 0.25))")} AS heat, {R("exp(-d * d / (2 * 0.25))")} AS gauss, {R("CASE WHEN d < 2 THEN exp(0.5 / (d * d - 4) + 0.5 / 4) ELSE 0 END")} AS bump,
  {R("exp(-d / 0.7)")} AS m12, {R("(1 + d / 0.7 * sqrt(3)) * exp(-d / 0.7 * sqrt(3))")} AS m32, {R("(1 + d / 0.7 * sqrt(5) + power(d / 0.7 * sqrt(5), 2) / 3) * exp(-d / 0.7 * sqrt(5))")} AS m52,
  {R("power(2 * 1.5 / 0.49 + d, -1.5)")} AS spec, {R("exp(-d * d / 1.5)")} AS med FROM d""",
)
def f12(spark, sf):
    d = F.col("d")
    rows = t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 125000).alias("d"))
    return rows.select("o_orderkey", r(x.heat(d * d, 0.5)).alias("heat"), r(x.gaussian(d * d, 0.5)).alias("gauss"), r(x.bump("d", 2.0, 0.5)).alias("bump"), *[r(x.matern("d", 0.7, nu)).alias(n) for nu, n in ((0.5, "m12"), (1.5, "m32"), (2.5, "m52"))], r(x.spectral_density("d", 0.7, 1.5)).alias("spec"), r(x.median_affinity(d * d, F.lit(1.5))).alias("med"))


@add("F17_fold_midline", f"SELECT s_suppkey, {R('abs(s_acctbal - 2500)')} AS folded FROM supplier")
def f17(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", r(x.fold_at("s_acctbal", 2500.0)).alias("folded"))


@add("F23_F30_slugs", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ': ' || p_type, ':', '-', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(split_part('hess' || p_size || '_0.2mm', '_', 1), '[0-9]+$', '') AS block FROM part")
def f23(spark, sf):
    return t(spark, sf, "part").select("p_partkey", x.slug(F.concat("p_name", F.lit(": "), "p_type")).alias("slug"), x.block_name(F.concat(F.lit("hess"), "p_size", F.lit("_0.2mm"))).alias("block"))


@add("F29_prefix_class", "SELECT CASE WHEN starts_with(event_type, 'si') THEN 'start' WHEN starts_with(event_type, 'p') THEN 'money' WHEN starts_with(event_type, 'e') THEN 'fault' ELSE 'look' END AS class, count(*) AS n FROM events GROUP BY 1")
def f29(spark, sf):
    return t(spark, sf, "events").groupBy(x.by_prefix("event_type", [("si", "start"), ("p", "money"), ("e", "fault")], "look").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "F32_J20_anchor_distances",
    f"""WITH a AS (SELECT vec_id AS anchor, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 5)
SELECT anchor, vec_id, {R("list_sum(list_transform(range(1, 65), lambda i: power(a.e[i] - b.embedding[i]::DOUBLE, 2)))", 5)} AS d2,
  {R("sqrt(greatest(2 - 2 * list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.e, lambda v: v * v))) / sqrt(list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v::DOUBLE))), 0))", 5)} AS cd
FROM a, embeddings b WHERE vec_id >= 5""",
)
def f32(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    a = e.where("vec_id < 5").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("a"))  # five anchors
    return e.where("vec_id >= 5").crossJoin(F.broadcast(a)).select("anchor", "vec_id", r(x.squared_distance("a", "embedding"), 5).alias("d2"), r(x.correlation_distance("a", "embedding"), 5).alias("cd"))


@add("F33_G38_diffusion_embedding", f"SELECT vec_id, {R('list_sum(list_transform(range(1, 9), lambda i: embedding[i]::DOUBLE * exp(-2 * (i - 1) / 8.0)))')} AS v FROM embeddings")
def f33(spark, sf):
    lam = F.array(*[F.lit(k / 8.0) for k in range(8)])
    phi = x.diffuse(F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 8), lam, 2.0)
    return t(spark, sf, "embeddings").select("vec_id", r(F.aggregate(phi, F.lit(0.0), lambda s, v: s + v)).alias("v"))


@add("F34_F39_losses", f"SELECT s_suppkey, {R('ln(1 + exp(s_nationkey / 10.0))')} AS soft, {R('0.5 * (ln(2 * pi()) + 0.3 + power(s_nationkey / 10.0 - 1, 2) / exp(0.3))')} AS nll, {R('0.5 * (exp(0.3) + power(s_nationkey / 10.0, 2) - 1 - 0.3)')} AS kl FROM supplier")
def f34(spark, sf):
    v = F.col("s_nationkey") / 10.0
    return t(spark, sf, "supplier").select("s_suppkey", r(x.softplus(v)).alias("soft"), r(x.gaussian_nll(v, F.lit(1.0), F.lit(0.3))).alias("nll"), r(x.sum_kl(v, F.lit(0.3))).alias("kl"))


@add(
    "F36_trilinear_weights",
    f"""WITH p AS (SELECT s_suppkey, s_acctbal / 100 AS x, s_nationkey / 3.0 AS y, s_suppkey / 7.0 AS z FROM supplier), c AS (SELECT a.v AS i, b.v AS j, c.v AS k FROM range(2) a(v), range(2) b(v), range(2) c(v))
SELECT s_suppkey, i, j, k, {R("CASE i WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE j WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE k WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END")} AS w FROM p, c""",
)
def f36(spark, sf):
    from ..operators.spatial import trilinear

    p = t(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") / 3.0).alias("y"), (F.col("s_suppkey") / 7.0).alias("z"))
    return trilinear(p, ["x", "y", "z"]).select("s_suppkey", i("i").alias("i"), i("j").alias("j"), i("k").alias("k"), r("w").alias("w"))


@add(
    "F37_F38_diffusion_schedule",
    f"""WITH b AS (SELECT t, 1e-4 + (0.02 - 1e-4) * t / 99.0 AS beta FROM range(100) g(t)), a AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS abar FROM b),
p AS (SELECT t, beta, abar, beta * (1 - coalesce(lag(abar) OVER (ORDER BY t), 1)) / (1 - abar) AS posterior FROM a)
SELECT c_custkey, {R("beta", 8)} AS beta, {R("posterior", 8)} AS posterior, {R("sqrt(abar) * c_acctbal / 1000 + c_nationkey / 25 + sqrt(1 - abar) * (c_custkey % 7 - 3)", 5)} AS noised FROM customer JOIN p ON t = c_custkey % 100""",
)
def f37(spark, sf):
    from ..operators.stats import ddpm_schedule

    steps = F.broadcast(ddpm_schedule(spark, 100, 1e-4, 0.02))  # a hundred rows, set by the schedule
    met = t(spark, sf, "customer").withColumn("t", F.col("c_custkey") % 100).join(steps, "t")
    noised = F.sqrt("abar") * F.col("c_acctbal") / 1000 + F.col("c_nationkey") / 25 + F.sqrt(1 - F.col("abar")) * (F.col("c_custkey") % 7 - 3)
    return met.select("c_custkey", r("beta", 8).alias("beta"), r("posterior", 8).alias("posterior"), r(noised, 5).alias("noised"))


@add("J3_join_on_grid_index", f"WITH a AS (SELECT k, k * 0.01 AS bw FROM range(1, 9) g(k)), b AS (SELECT k, count(*) AS n FROM (SELECT o_orderkey % 12 AS k FROM orders) GROUP BY k) SELECT a.k, {R('bw')} AS bw, n FROM a JOIN b ON a.k = b.k")
def j3(spark, sf):
    a = spark.range(1, 9).select(F.col("id").alias("k"), (F.col("id") * 0.01).alias("bw"))
    b = t(spark, sf, "orders").groupBy((F.col("o_orderkey") % 12).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "k").select("k", r("bw").alias("bw"), "n")


@add("J10_J11_J29_label_lookup", f"SELECT coalesce(n_name, 'out of bounds') AS region, count(*) AS n, {R('avg(c_acctbal)', 3)} AS mean FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey GROUP BY 1")
def j10(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey <> 2")
    c = t(spark, sf, "customer")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").groupBy(F.coalesce("n_name", F.lit("out of bounds")).alias("region")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal"), 3).alias("mean"))


@add("J25_gather_endpoints", "SELECT a.n_regionkey AS src_region, b.n_regionkey AS dst_region, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2")
def j25(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    li, o = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("src_region"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("dst_region"))
    met = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy("src_region", "dst_region").agg(F.count(F.lit(1)).alias("n"))


@add(
    "J22_J23_W11_bracketing",
    f"""WITH e AS (SELECT user_id, event_id, ts, value, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, lag(value) OVER w AS v0, lead(value) OVER w AS v1, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, before, after, {R("(v0 + v1) / 2")} AS guess FROM e WHERE n >= 3 AND before IS NOT NULL AND after IS NOT NULL AND k <= 10""",
)
def j23(spark, sf):
    from ..operators.spatial import bracketed

    out = bracketed(t(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "event_id", cap=10)
    mean = (F.col("before.value") + F.col("after.value")) / 2
    return out.select("event_id", F.col("before.event_id").alias("before"), F.col("after.event_id").alias("after"), r(mean).alias("guess"))


@add(
    "J32_cycled_pairing",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer), b AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT c_custkey, n_nationkey FROM a JOIN b ON (3 + a.k) % 25 = b.k""",
)
def j32(spark, sf):
    from ..operators.spatial import cycled_pairs

    return cycled_pairs(t(spark, sf, "customer"), ["c_custkey"], t(spark, sf, "nation"), ["n_nationkey"], 3).select("c_custkey", "n_nationkey")


@add("R1_R2_R3_union_with_provenance", "SELECT 'customer' AS source, c_nationkey AS nation, NULL AS segment, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, 'none', count(*) FROM supplier GROUP BY 2")
def r1(spark, sf):
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("customer"))
    s = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("supplier")).withColumn("segment", F.lit("none"))
    return c.unionByName(s, allowMissingColumns=True).select("source", "nation", "segment", "n")


@add("R5_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'members', count(*) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def r5(spark, sf):
    c, s = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(c.intersect(s), "both").unionByName(count(c.subtract(s), "only customers")).unionByName(count(c.join(s, "k", "left_semi"), "members"))


@add("R8_R10_melt", f"SELECT l_returnflag, channel, count(v) AS n, {R('sum(v)', 2)} AS total FROM (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR channel IN (l_quantity, l_discount, l_tax)) GROUP BY 1, 2")
def r8(spark, sf):
    return t(spark, sf, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "channel", "v").groupBy("l_returnflag", "channel").agg(F.count("v").alias("n"), r(F.sum("v"), 2).alias("total"))


@add("R11_compact_relabel", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand FROM part")
def r11(spark, sf):
    from ..operators.clean import compact_labels

    return compact_labels(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "brand").select("p_partkey", i("brand").alias("brand"))


@add("B2_sample_per_group", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5:' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 4")
def b2(spark, sf):
    return sampling.sample_per_group(t(spark, sf, "customer"), ["c_nationkey"], 4, 5, "c_custkey").select("c_custkey", "c_nationkey")


@add("B3_group_folds", "WITH g AS (SELECT DISTINCT c_nationkey FROM customer) SELECT c_nationkey, CAST((dense_rank() OVER (ORDER BY md5('2:' || c_nationkey), c_nationkey) - 1) % 4 AS INTEGER) AS fold FROM g")
def b3(spark, sf):
    return sampling.group_folds(t(spark, sf, "customer"), ["c_nationkey"], 4, 2)


@add("B5_train_val_split", "SELECT is_val, count(*) AS n FROM (SELECT CAST('0x' || substr(md5('9:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 AS is_val FROM orders) GROUP BY 1")
def b5(spark, sf):
    return sampling.split(t(spark, sf, "orders"), 0.1, 9, "o_orderkey").groupBy("is_val").agg(F.count(F.lit(1)).alias("n"))


@add(
    "B12_quantile_matched",
    """WITH k AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS bin FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('4:' || o_orderkey), o_orderkey) AS n FROM k)
SELECT o_orderkey, CAST(bin AS INTEGER) AS bin FROM n WHERE n <= CASE bin WHEN 0 THEN 20 WHEN 1 THEN 30 ELSE 5 END""",
)
def b12(spark, sf):
    return sampling.match_quantiles(t(spark, sf, "orders"), "o_totalprice", [100000.0, 200000.0], [20, 30, 5], 4, "o_orderkey").select("o_orderkey", F.col("bin").cast("int").alias("bin"))


@add("B13_weighted_sample", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY -ln(CAST('0x' || substr(md5('6:' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0 + 1e-12) / c_acctbal, c_custkey LIMIT 50")
def b13(spark, sf):
    return sampling.weighted_sample(t(spark, sf, "customer"), "c_acctbal", 50, 6, "c_custkey").select("c_custkey")


def _farthest_sql(n: int) -> str:
    """One CTE for each point chosen: the others with their distance to the nearest chosen one, and the farthest of them."""
    d2 = "(m.x - c.x) * (m.x - c.x) + (m.y - c.y) * (m.y - c.y) + (m.z - c.z) * (m.z - c.z)"
    ctes = ["m0 AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, CAST('infinity' AS DOUBLE) AS d FROM embeddings)", "c0 AS (SELECT * FROM m0 ORDER BY vec_id LIMIT 1)"]
    for k in range(1, n):
        ctes.append(f"m{k} AS (SELECT m.vec_id, m.x, m.y, m.z, least(m.d, {d2}) AS d FROM m{k - 1} m, c{k - 1} c WHERE m.vec_id <> c.vec_id)")
        ctes.append(f"c{k} AS (SELECT * FROM m{k} ORDER BY d DESC, vec_id LIMIT 1)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT vec_id, {k} AS nth FROM c{k}" for k in range(n))


@add("B14_farthest_points", _farthest_sql(12))
def b14(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")])
    return sampling.farthest_points(e, "vec_id", ["x", "y", "z"], 12)


@add("K6_K7_W8_latest_and_todo", f"WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) SELECT user_id, event_id, event_type, {R('value')} AS value FROM l WHERE event_type <> 'error'")
def k7(spark, sf):
    last = sinks.latest(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    failed = last.where("event_type = 'error'").select("user_id")
    return sinks.todo(last, failed, "user_id").select("user_id", "event_id", "event_type", r("value").alias("value"))


@add("K9_K11_K12_K15_cache_keys", r"WITH f AS (SELECT 'eig_s' || (s_suppkey % 4) || '_m' || (s_suppkey * 10) || '.npz' AS path FROM supplier) SELECT path, regexp_extract(path, '_s([0-9]+)', 1) AS stride, CAST(regexp_extract(path, '_m([0-9]+)', 1) AS INTEGER) AS modes FROM f WHERE CAST(regexp_extract(path, '_m([0-9]+)', 1) AS INTEGER) >= 35 ORDER BY modes LIMIT 1")
def k11(spark, sf):
    files = t(spark, sf, "supplier").select(F.concat(F.lit("eig_s"), F.col("s_suppkey") % 4, F.lit("_m"), F.col("s_suppkey") * 10, F.lit(".npz")).alias("path"))
    found = sinks.inventory(files, "path", {"stride": r"_s([0-9]+)", "modes": r"_m([0-9]+)"}).withColumn("modes", F.col("modes").cast("int"))
    return sinks.smallest_superset(found, "modes", 35)
