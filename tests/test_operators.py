"""Operators on small frames, against plain versions."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import exprs as x
from lodestrata.operators import bins, clean, graph, grouped, learn, metrics, sampling, spatial, stats
from lodestrata.plans.components import components
from lodestrata.sources import readers, sinks

numbers = st.one_of(st.floats(-100, 100), st.sampled_from([float("nan"), float("inf"), None]))
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=30))
def test_scores_equal_numpy(spark, rows):
    df = spark.createDataFrame([("k", a, b) for a, b in rows], "k string, y_true double, y_pred double")
    got = metrics.score(df, ["k"]).first()
    ok = [(a, b) for a, b in rows if a is not None and b is not None and math.isfinite(a) and math.isfinite(b)]
    assert got.n == len(ok)
    if not ok:
        assert got.r2 is None and got.rmse is None
        return
    y, p = np.array(ok).T
    assert math.isclose(got.rmse, np.sqrt(((y - p) ** 2).mean()), rel_tol=1e-9, abs_tol=1e-9)
    if y.std() > 1e-6:
        assert math.isclose(got.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-6, abs_tol=1e-6)
        if p.std() > 1e-6:
            assert math.isclose(got.corr, np.corrcoef(y, p)[0, 1], rel_tol=1e-6, abs_tol=1e-6)


def test_scores_of_constants_and_single_rows(spark):
    rows = [("const", 1.0, 2.0), ("const", 1.0, 3.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("one", 1.0, 1.0), ("none", None, 1.0)]
    got = {r.k: r for r in metrics.score(spark.createDataFrame(rows, "k string, y_true double, y_pred double"), ["k"]).collect()}
    assert got["const"].r2 is None and got["const"].corr is None and got["flat"].corr is None and got["flat"].r2 < 0
    assert got["one"].n == 1 and got["one"].r2 is None and got["one"].rmse == 0 and got["none"].n == 0


def test_dnf_reaches_the_reader(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("g"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    df = readers.scan(spark, str(tmp_path / "t"), ["id"], [[("g", "==", 1), ("id", "<", 50)], [("g", "in", [2]), ("id", ">=", 90)]])
    assert sorted(r.id for r in df.collect()) == [i for i in range(100) if (i % 3 == 1 and i < 50) or (i % 3 == 2 and i >= 90)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "wide" not in plan
    assert readers.and_in([("a", "==", 1)], "s", [2]) == [[("a", "==", 1), ("s", "in", [2])]]
    assert spark.range(3).where(readers.dnf([])).count() == 3


def test_splits_and_folds(tmp_path):
    a = {"train": [("S", "==", "A")], "test": [("S", "==", "B")], "ignore": []}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(a))
    assert readers.load_split(str(path)) == a
    assert readers.duplicate_folds({"f1": a, "f2": {**a, "test": [("S", "==", "C")]}, "f3": dict(a)}) == [("f1", "f3")]
    assert readers.parse_tokens("4:100,8:50") == [(4, 100), (8, 50)]
    assert readers.resolve_channels(["PC 1", "PE 2", "LPC 3"], [1, "PC 1", "no", 1]) == ["PE 2", "PC 1"]
    assert readers.resolve_channels(["PC 1", "PE 2"], ["pe"], strict=True) == ["PE 2"]
    with pytest.raises(KeyError):
        readers.resolve_channels(["PC 1", "PC 2"], ["pc"], strict=True)


def test_metric_files_runs_and_arrays(spark, tmp_path):
    for root, run, body in (("a", "r1", "k,v\nx,1.5\ny,oops\n"), ("b", "r1", "k,v\nx,9\n"), ("b", "r2", "k,v\nz,2\n")):
        (tmp_path / root / run).mkdir(parents=True)
        (tmp_path / root / run / "metrics.csv").write_text(body)
    runs = readers.discover_runs(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.run, r.path.split("/")[-3]) for r in runs.collect()) == [("r1", "a"), ("r2", "b")]
    got = readers.metric_files(spark, str(tmp_path / "*/*/metrics.csv"), "k string, v double")
    assert sorted(r.v for r in got.collect()) == [1.5, 2.0, 9.0]
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    rows = readers.arrays(spark, str(tmp_path / "m.npy"), ["a", "b"]).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, 1.0), (1, 2.0, 3.0), (2, 4.0, 5.0)]


def test_whole_sections_and_coarsening(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 5), ("b", 3), ("c", 4)) for i in range(n)], "s string, i int")
    got = readers.whole_sections(df, "s", [F.col("s")], 8).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"a": 5, "b": 3}
    tree = spark.createDataFrame([(1, [9, 1]), (2, [9, 1, 2]), (9, [9])], "id int, path array<int>")
    labels = spark.createDataFrame([(2,), (9,), (7,)], "region int")
    assert sorted(r.region for r in readers.coarsen(labels, tree, 1).collect()) == [1, 7, 9]


def test_resume_and_caches(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "c")
    assert sinks.compute_or_load(spark, path, compute).count() == 3 and sinks.compute_or_load(spark, path, compute).count() == 3 and len(calls) == 1
    sinks.compute_or_load(spark, path, compute, force=True)
    assert len(calls) == 2
    assert sinks.config_key({"b": 0.1234567, "a": 3}) == "a3_b0.123457" and sinks.set_signature(["b", "a"]) == sinks.set_signature(["a", "b"])
    a, b = spark.range(3), spark.range(3).unionAll(spark.range(1))
    assert sinks.same_set(a, b, "id") and not sinks.same_set(a, spark.range(2), "id")
    assert sorted(r.id for r in sinks.todo(spark.range(4), spark.range(2), "id").collect()) == [2, 3]
    sinks.write_reports({"r": spark.range(2)}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/r"), header=True).count() == 2


def brute_knn(p, k):
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    out = set()
    for i in range(len(p)):
        order = sorted((d[i, j], j) for j in range(len(p)) if j != i)[:k]
        out |= {(i, j) for _, j in order}
    return out


def test_vector_knn_and_radius(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 3, (70, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, v array<double>").repartition(3)
    got = {(r.src, r.dst) for r in spatial.vector_knn(df, df, "id", "v", 3, block=16).collect()}
    assert got == brute_knn(p, 3)
    q = spark.createDataFrame([(i, *map(float, v[:2])) for i, v in enumerate(p)], "id long, x double, y double")
    pairs = {(r.src, r.dst) for r in spatial.radius_pairs(q, "id", ["x", "y"], 1.0).collect()}
    assert pairs == {(i, j) for i in range(70) for j in range(i + 1, 70) if ((p[i, :2] - p[j, :2]) ** 2).sum() <= 1.0}
    s = spatial.snap(q.where("id < 10"), q.where("id >= 10 and id < 13"), "id", "id", ["x", "y"], 1.0)
    assert s.count() <= 10 and spatial.snap(q.limit(0), q, "id", "id", ["x", "y"], 1.0).count() == 0


@few
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_union_find(spark, pairs):
    parent = list(range(26))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 201 + 301


def test_graph_properties(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(p)], "id long, v array<double>, label int")
    e = spatial.edges_from(spatial.vector_knn(df, df, "id", "v", 3)).cache()
    rows = e.collect()
    assert all(r.src < r.dst for r in rows) and len({(r.src, r.dst) for r in rows}) == len(rows)
    same = graph.inflate(e, df, "id", "label", 1.0)
    assert {(r.src, r.dst, r.d2) for r in same.select("src", "dst", "d2").collect()} == {tuple(r) for r in rows}
    for share in (0.5, 1.0):
        kept = graph.prune(same, share, 1)
        assert {n for r in kept.collect() for n in (r.src, r.dst)} == {n for r in rows for n in (r.src, r.dst)}
    parts = graph.laplacian(e, 0.8)
    one = graph.random_walk(parts, df.select(F.col("id").alias("node"), F.lit(1.0).alias("x")))
    assert all(abs(r.y - 1) < 1e-9 for r in one.collect())
    entries = graph.laplacian_entries(parts, 0.8)
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=40))], "node long, x double")
    whole = np.zeros((40, 40))
    for r in entries.collect():
        whole[r.i, r.j] = whole[r.j, r.i] = r.v
    got = {r.node: r.y for r in graph.matvec(entries, x).collect()}
    want = whole @ np.array([r.x for r in x.orderBy("node").collect()])
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(40))


def test_votes_bridges_and_parcels(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, d2 double")
    labels = spark.createDataFrame([(0, 5), (1, 7), (2, 5), (3, 2), (4, 1)], "node long, label long")
    assert {r.node: r.label for r in graph.majority_vote(e, labels, 3).collect()} == {0: 5, 1: 5, 2: 5, 3: 1, 4: 1}
    geo = graph.geodesic(e, spark.createDataFrame([(0,)], "node long"), 5.0)
    assert {(r.node, r.d) for r in geo.collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    con = {r.bw: r for r in graph.connectivity(labels.select("node"), e, [0.1, 10.0], 0.5).collect()}
    assert con[10.0].n_components == 2 and con[0.1].n_components == 5 and con[0.1].isolated_share == 1.0


def test_ranks_rasters_and_bins(spark):
    df = spark.range(101).select("id", ((F.col("id") * 37) % 101).alias("v"))
    assert all(r.rank == r.v for r in bins.global_rank(df, ["v"], parts=5).collect())
    counts = bins.ntile_bins(df, "v", "id", 4).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in counts] == [26, 25, 25, 25]
    assert [r.v for r in bins.picks_along(df, ["v"], 5).orderBy("v").collect()] == [0, 25, 50, 75, 100]
    h = bins.histogram(df, [], "v", 10)
    assert h.agg(F.sum("n")).first()[0] == 101 and h.count() == 10


def test_scaling_round_trip_and_pooled_deviation(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 3)) * [1, 5, 2] + [10, 0, -4]
    df = spark.createDataFrame([tuple(map(float, v)) for v in m], "a double, b double, c double")
    z = clean.ZScore.fit(df, ["a", "b"])
    back = np.array(z.inverse(z.transform(df)).select("a", "b").collect())
    assert np.allclose(sorted(back[:, 0]), sorted(m[:, 0]))
    assert math.isclose(clean.standardise_coordinates(df, ["a", "b", "c"]).first()._scale, m.std(), rel_tol=1e-12)


def test_statistics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y, g, f = rng.normal(size=200), rng.integers(0, 5, 200), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(y, g, f, strict=True)], "y double, g int, f int")
    means = np.array([y[g == k].mean() for k in range(5)])[g]
    assert math.isclose(stats.eta_squared(df, [], "g", "y").first().eta2, ((means - y.mean()) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    for r in stats.held_out_group_mean(df, [], "g", "f", "y").collect():
        te, tr = f == r.f, f != r.f
        p = np.array([y[tr & (g == k)].mean() for k in range(5)])[g[te]]
        assert math.isclose(r.ev, 1 - ((y[te] - p) ** 2).sum() / ((y[te] - y[tr].mean()) ** 2).sum(), rel_tol=1e-9)
    u = np.round(rng.normal(size=60), 1)
    s = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, u**3 + rng.normal(size=60), strict=True)], "a double, b double")
    rows = np.array(s.collect())

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert math.isclose(metrics.spearman(s, [], "a", "b").first()[0], np.corrcoef(rank(rows[:, 0]), rank(rows[:, 1]))[0, 1], rel_tol=1e-9)
    several = spark.createDataFrame([(k, *map(float, r)) for k in ("x", "y", None) for r in rows[: 60 if k == "x" else 25]] + [("flat", 1.0, float(i)) for i in range(4)], "k string, a double, b double")
    plain = {k: np.corrcoef(rank(rows[:n, 0]), rank(rows[:n, 1]))[0, 1] for k, n in (("x", 60), ("y", 25), (None, 25))}
    for most in (metrics.WINDOW_ROWS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(metrics, "WINDOW_ROWS", most)
            got = {r.k: r.spearman for r in metrics.spearman(several, ["k"], "a", "b").collect()}
        assert got.pop("flat") is None and got.keys() == plain.keys() and all(math.isclose(got[k], plain[k], rel_tol=1e-9) for k in plain)
    grid = spark.createDataFrame([(float(k), float(k**3)) for k in (1, 2, 4, 9)], "x double, y double")
    assert all(abs(r.slope - 3) < 1e-9 for r in stats.log_slope(grid, "x", "y").collect())
    sums = df.agg(*stats.weighted_std("y", "g")).select(stats.finish_weighted_std().alias("s")).first().s
    w = g[g > 0]
    assert math.isclose(sums, math.sqrt(np.average((y[g > 0] - np.average(y[g > 0], weights=w)) ** 2, weights=w)), rel_tol=1e-9)


def test_spearman_of_models_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(metrics, "WINDOW_ROWS", 25)
    rng = np.random.default_rng(12)
    n = 240
    key = rng.integers(0, 3, n)
    y = np.where(rng.random(n) < 0.5, 7.0, np.round(rng.normal(7, 2, n), 1))  # half of the truths are equal: they lie in several ranges
    p = {"tied": np.where(rng.random(n) < 0.6, 0.0, y), "near": y + rng.normal(size=n), "flat": np.full(n, 3.0)}
    p["tied"][:5], y[5:8], y[8:10] = np.nan, np.nan, np.inf
    rows = [(None if k == 2 else int(k), None if i in (20, 21) else float(y[i]), *[float(v[i]) for v in p.values()]) for i, k in enumerate(key)]
    got = {(r.k, r.model): r.spearman for r in metrics.spearman_models(spark.createDataFrame(rows, "k int, y double, tied double, near double, flat double"), ["k"], list(p), "y").collect()}

    def ranks(v):
        place = [(0, 0.0) if a is None else (2, 0.0) if a != a else (1, a) for a in v]
        return [sum(b < a for b in place) + (place.count(a) + 1) / 2 for a in place]

    for k in (0, 1, None):
        mine = [r for r in rows if r[0] == k]
        for c, model in enumerate(p, 2):
            a, b = np.array(ranks([r[1] for r in mine])), np.array(ranks([r[c] for r in mine]))
            want = None if model == "flat" else np.corrcoef(a, b)[0, 1]
            assert got[k, model] is None if want is None else math.isclose(got[k, model], want, rel_tol=1e-9)
    assert len(got) == 9
    assert metrics.spearman(spark.createDataFrame([], "k int, a double, b double"), ["k"], "a", "b").collect() == []


def test_large_channels_of_a_process_are_solved_by_sums(spark, monkeypatch):
    monkeypatch.setattr(grouped, "ROWS", 300, raising=False)
    monkeypatch.setattr(grouped, "DENSE", 100, raising=False)
    rng = np.random.default_rng(8)
    rows = [(k, i, *map(float, rng.random(2) * 0.4), float(rng.normal()), "test" if i % 5 == 0 else "train") for k, n in ((1, 900), (None, 700), (2, 60)) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "c int, id long, x double, y double, v double, split string").repartition(5)
    calls = []
    monkeypatch.setattr(grouped, "_by_sums", lambda *a, f=grouped._by_sums: calls.append(1) or f(*a))
    got = {(r.c, r.id): r for r in grouped.gp_by_channel(df, "c", ["x", "y"], "v", "split", "id", 0.3).collect()}
    assert calls and len(got) == sum(r[5] == "test" for r in rows)
    for c in (1, None, 2):
        own = pd.DataFrame(sorted([r for r in rows if r[0] == c], key=lambda r: r[1]), columns=["c", "id", "x", "y", "v", "split"])
        new = own[own.split == "test"]
        want, noise = grouped.gp_regression(own[own.split == "train"], new, ["x", "y"], "v", 0.3)
        assert np.allclose([got[c, i].prediction for i in new.id], want, atol=1e-8) and {got[c, i].noise for i in new.id} == {noise}


def test_samples_and_tests(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("g"), (F.col("id") + 1.0).alias("w"))
    assert sampling.sample(df, 30, 1, "id").count() == 30
    assert {r["count"] for r in sampling.sample_per_group(df, ["g"], 7, 1, "id").groupBy("g").count().collect()} == {7}
    assert sampling.weighted_sample(df, "w", 20, 1, "id").select("id").distinct().count() == 20
    far = sampling.farthest_points(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 10.0), (3, 5.5)], "id long, x double"), "id", ["x"], 3)
    assert [r.id for r in far.orderBy("nth").collect()] == [0, 2, 3]
    d = spark.createDataFrame([(float(v),) for v in (1, 2, -3, 4, 0)], "d double")
    assert tuple(sampling.sign_test(d, "d").first())[:2] == (3, 4)
    assert tuple(sampling.wilcoxon(d, "d").first()) == (4, 7.0, 3.0)
    p = spark.range(1).select(x.erfc(F.lit(0.7))).first()[0]
    assert abs(p - math.erfc(0.7)) < 2e-7


def test_learners(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 + 2 * a - b)) for i, (a, b) in enumerate(m)], "id long, a double, b double, y double")
    model = learn.REGISTRY["ridge"](0.0).fit(df, ["a", "b"], "y")
    assert np.allclose(model.weights, [3, 2, -1])
    assert metrics.score(learn.REGISTRY["mean"]().fit(df, [], "y").predict(df), [], "y", "prediction").first().corr is None
    assert abs(metrics.score(learn.Boosting(5, 3).fit(df, ["a", "b"], "y", "id").predict(df), [], "y", "prediction").first().r2 - 0.8) < 0.25
    assert learn.centres_to_points(df, "id", ["a", "b"], 5).count() <= 5
    assert learn.mirrored_kmeans(df, "id", ["a", "b"], "a", 3).count() <= 6
    pooled = df.select(F.lit("c").alias("channel"), "id", "a", "b", "y", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    out = grouped.gp_by_channel(pooled, "channel", ["a", "b"], "y", "split", "id", 1.0)
    assert metrics.score(out.join(df, "id"), [], "y", "prediction").first().r2 > 0.9
    t = np.linspace(0, 1, 256, endpoint=False)
    assert np.allclose(grouped.envelope(np.sin(2 * np.pi * 16 * t)), 1.0)


def test_fields_and_spectral_regression(spark):
    rng = np.random.default_rng(7)
    m = rng.uniform(size=(150, 3))
    df = spark.createDataFrame([(i, *map(float, v), float(np.sin(3 * v[0]) + v[1])) for i, v in enumerate(m)], "id long, x double, y double, z double, t double")
    field = learn.HashField((2, 4), 256, 6).fit(df, "id", ["x", "y", "z"], "t")
    assert metrics.score(field.predict(df), [], "t", "prediction").first().r2 > 0.9
    out = learn.SpectralRegression([1.0, 4.0], 0.1).fit(df, ["x", "y"], "t").predict(df, "p", "v").collect()
    f = np.array([[r.x, r.y] for r in out])
    cov = np.linalg.inv(f.T @ f / 0.1 + np.diag([1.0, 0.25]))
    assert np.allclose([r.p for r in out], f @ cov @ f.T @ np.array([r.t for r in out]) / 0.1)
    assert np.allclose([r.v for r in out], 0.1 + np.einsum("ij,jk,ik->i", f, cov, f))


def test_streams_add_up_to_the_batch(spark, tmp_path):
    from lodestrata.streaming import accumulate

    src = str(tmp_path / "in")
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") * 1.0).alias("y"), (F.col("id") * 1.1 + F.col("id") % 7).alias("p"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 30).alias("ts"))
    rows.repartition(4).write.parquet(src)
    stream = accumulate.stream_table(spark, src, rows.schema)
    sums = accumulate.run_to_end(stream.groupBy("k").agg(*accumulate.score_sums("y", "p")), "sums", "complete")
    got = {r.k: r for r in accumulate.finish_scores(accumulate.merge(sums, ["k"]), ["k"]).collect()}
    for r in metrics.score(rows, ["k"], "y", "p").collect():
        assert got[r.k].n == r.n and math.isclose(got[r.k].r2, r.r2, rel_tol=1e-9) and math.isclose(got[r.k].corr, r.corr, rel_tol=1e-9)
    means = accumulate.run_to_end(accumulate.windowed_mean(stream, "ts", ["k"], "y", "10 minutes", "1 day"), "means", "complete")
    assert means.agg(F.sum("n")).first()[0] == 400


def test_plane_projection_and_layout(spark):
    rng = np.random.default_rng(6)
    rows = [(s, s * 100 + i, *map(float, v)) for s in range(2) for i, v in enumerate(rng.normal(size=(30, 3)) * [5, 2, 0.01])]
    df = spark.createDataFrame(rows, "s int, id long, x double, y double, z double")
    out = spatial.plane_projection(df, ["s"], ["x", "y", "z"], "id").groupBy("s").agg(F.var_pop("u").alias("u"), F.var_pop("v").alias("v")).collect()
    assert all(r.u > r.v > 0.5 for r in out)
    assert readers.swiss_roll(spark, 10).count() == 10 and readers.box_and_cylinder(spark, 50).where("label = 2").count() < 50
    sec = spark.createDataFrame([("m", 0.0, 1, 10), ("m", 1.0, 2, 20), ("m", 1.0, 3, 5), ("m", 3.0, 4, 10)], "m string, z double, id int, n int")
    assert [(r.id, r.next) for r in spatial.adjacent_pairs(sec, ["m"], "z", "id", "n", 100).orderBy("id").collect()] == [(1, 2), (3, 4)]


def test_a_failed_run_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(3), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(broken, path)
    assert spark.read.parquet(path).count() == 3
    sinks.publish(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if "table." in p.name] == []


def test_cut_starts_no_process_for_the_driver(spark, tmp_path, monkeypatch):
    from lodestrata.plans import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    got = shared.cut(spark.range(10), "ten")
    folder = next(tmp_path.iterdir())
    assert sorted(r.id for r in got.collect()) == list(range(10))
    # a marker that is not made needs no chmod; nothing of the write's own folders is left
    assert {p.suffix for p in folder.iterdir()} == {".parquet", ".crc"}


def test_vector_knn_tasks_are_bounded_cells(spark, monkeypatch):
    """More rows make more tasks, not longer ones, and every cell has its own."""
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(240, 6))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vec)], "id long, v array<double>")
    monkeypatch.setattr(spatial, "SIDE", 40)
    seen, real = [], spatial._nearest

    def counted(k, rule):
        def of(frames):
            met = {True: 0, False: 0}

            def passed():
                for f in frames:
                    for row in f.itertuples():
                        met[row.queries] += len(row.keys) // 8
                    yield f

            found = list(real(k, rule)(passed()))
            assert met[True] <= 80 and met[False] <= 80, met
            yield from found

        seen.append(k)
        return of

    monkeypatch.setattr(spatial, "_nearest", counted)
    got = {r.src: r for r in spatial.vector_knn(df, df, "id", "v", 1, block=16).collect()}
    d2 = ((vec[:, None] - vec[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    assert seen == [1] and all(got[i].dst == d2[i].argmin() for i in range(240))


def test_snap_makes_no_pairs_of_a_dense_place(spark, monkeypatch):
    """Every point lies within the distance of every node; only the nearest one is sought."""
    rng = np.random.default_rng(8)
    at = rng.uniform(0, 0.01, size=(400, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    monkeypatch.setattr(spatial, "radius_join", lambda *_: pytest.fail("all pairs within the distance were made"))
    got = {r.id: r for r in spatial.snap(df.where("id % 2 = 1"), df.where("id % 2 = 0"), "id", "id", ["x", "y", "z"], 0.004).collect()}
    d2 = ((at[1::2, None] - at[None, ::2]) ** 2).sum(axis=2)
    want = {2 * i + 1: 2 * int(d.argmin()) for i, d in enumerate(d2) if d.min() <= 0.004**2}
    assert {k: r.node for k, r in got.items()} == want
