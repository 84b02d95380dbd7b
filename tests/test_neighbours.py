"""Neighbours by tree, eigenpairs, geodesic neighbours, dissolved parcels and processes over neighbours, each against a plain version."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import eigen, graph, knn_tree, local_gp, spatial


def frame(spark, p, **more):
    names = [f"c{i}" for i in range(p.shape[1])]
    rows = [(i, *map(float, v), *[float(m[i]) for m in more.values()]) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in [*names, *more])), names


def brute(q, p, k, same):
    out = set()
    for i in range(len(q)):
        d = ((p - q[i]) ** 2).sum(axis=1)
        if same:
            d[i] = np.inf
        out |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(p)), d))[:k]) if np.isfinite(d[j])}
    return out


def shapes():
    rng = np.random.default_rng(3)
    yield "even", rng.random((700, 3))
    yield "clusters and outliers", np.vstack([rng.normal(0, 1e-3, (300, 3)), rng.normal(0, 1, (300, 3)), [[90.0, 0, 0], [-1e9, 5, 5]]])
    yield "copies", np.vstack([np.zeros((500, 2)), rng.integers(0, 4, (200, 2))])
    yield "a line", np.column_stack([rng.random(400), np.zeros(400)])
    yield "few", rng.random((3, 3))


@pytest.mark.parametrize("name,p", list(shapes()), ids=[n for n, _ in shapes()])
def test_tree_knn_equals_brute_force(spark, monkeypatch, name, p):
    monkeypatch.setattr(knn_tree, "LEAF", 40)
    monkeypatch.setattr(knn_tree, "VISITS", 2)
    monkeypatch.setattr(knn_tree, "CHUNK", 150)
    df, names = frame(spark, p)
    got = {(r.src, r.dst, r.rank) for r in knn_tree.tree_knn(df, df, "id", names, 4, same=True).collect()}
    assert got == brute(p, p, 4, True)
    if name == "clusters and outliers":
        q = np.vstack([p[::9] + 0.01, [[1e6, 0, 0]]])
        asked, _ = frame(spark, q)
        assert {(r.src, r.dst, r.rank) for r in knn_tree.tree_knn(asked, df, "id", names, 3).collect()} == brute(q, p, 3, False)


def test_tree_knn_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, None, 0.0), (2, float("nan"), 0.0), (3, 1.0, 0.0), (None, 0.0, 0.0), (4, float("inf"), 0.0)], "id long, x double, y double")
    assert {(r.src, r.dst) for r in knn_tree.tree_knn(df, df, "id", ["x", "y"], 2, same=True).collect()} == {(0, 3), (3, 0)}
    assert knn_tree.tree_knn(df.limit(0), df, "id", ["x", "y"], 2).count() == 0 and knn_tree.tree_knn(df, df.limit(0), "id", ["x", "y"], 2).count() == 0


def laplacian_of(spark, p, k=3, bandwidth=0.8):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, v array<double>")
    parts = graph.laplacian(spatial.edges_from(spatial.vector_knn(df, df, "id", "v", k)).cache(), bandwidth)
    entries = graph.laplacian_entries(parts, bandwidth)
    whole = np.zeros((len(p), len(p)))
    for r in entries.collect():
        whole[r.i, r.j] = whole[r.j, r.i] = r.v
    return entries, whole


def test_smallest_eigenpairs_equal_eigh(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(size=(45, 4)), rng.normal(30, 1, size=(15, 4))])  # two components: a double zero
    entries, whole = laplacian_of(spark, p)
    lam, vec = np.linalg.eigh(whole)
    found, x = eigen.smallest(entries, 4)
    assert np.allclose([f["eigenvalue"] for f in found], lam[:4], atol=1e-9) and max(f["residual"] for f in found) < 1e-6
    assert eigen.orthonormality_error(x) < 1e-10
    assert np.allclose(eigen.residuals(entries, x, [f["eigenvalue"] for f in found]), [f["residual"] for f in found], atol=1e-9)
    plain = spark.createDataFrame([(i, *map(float, v[:4])) for i, v in enumerate(vec)], "node long, a double, b double, c double, d double")
    assert max(eigen.principal_angles(x, plain)) < 1e-3
    turned = spark.createDataFrame([(i, float(vec[i, 0]), float((vec[i, 1] + vec[i, 5]) / 2**0.5)) for i in range(60)], "node long, a double, b double")
    flat = spark.createDataFrame([(i, float(vec[i, 0]), float(vec[i, 1])) for i in range(60)], "node long, a double, b double")
    assert np.allclose(eigen.principal_angles(turned, flat), [0, 45], atol=1e-4)


def test_eigenpairs_of_small_matrices(spark):
    tiny = spark.createDataFrame([(7, 7, 2.0), (7, 9, 1.0), (9, 9, 2.0)], "i long, j long, v double")
    found, x = eigen.smallest(tiny, 5)
    assert np.allclose([f["eigenvalue"] for f in found], [1, 3]) and x.count() == 2
    assert eigen.smallest(tiny.limit(0), 3)[0] == []


def test_eigenpairs_across_parts(spark, monkeypatch):
    monkeypatch.setattr(eigen, "PART", 16)  # five parts
    rng = np.random.default_rng(6)
    entries, whole = laplacian_of(spark, rng.normal(size=(80, 3)))
    lam, vec = np.linalg.eigh(whole)
    found, x = eigen.smallest(entries, 4)
    assert np.allclose([f["eigenvalue"] for f in found], lam[:4], atol=1e-9) and max(f["residual"] for f in found) < 1e-6
    assert eigen.orthonormality_error(x) < 1e-10
    parts = eigen.Parts(eigen._both(entries), 5)
    of = {r.node: r.p for r in spark.range(80).select(F.col("id").alias("node"), eigen._part("id", 5).alias("p")).collect()}
    # a node's numbers go once to each other part with a neighbour, whatever the number of its neighbours there
    sent = sum(len(rows) for _, (_, links) in parts.links.collect() for rows in links.values())
    assert sent == len({(i, of[j]) for i, j in np.argwhere(whole).tolist() if of[i] != of[j]})
    block = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vec[:, 3:5])], "node long, x0 double, x1 double")
    got = {r.node: (r.b2_0, r.b2_1) for r in eigen._recur(parts, block, 2, 2, 1.0, 2.0, keep=True).collect()}
    scaled = (whole - np.eye(80)) / 2
    assert np.allclose([got[i] for i in range(80)], 2 * scaled @ scaled @ vec[:, 3:5] - vec[:, 3:5])


def test_eigenpairs_below_a_wide_gap(spark):
    # one value far below the rest: a filter of a fixed degree leaves every column pointing at it
    lam = np.concatenate([[0.0], np.linspace(0.9, 1.0, 39)])
    entries = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(lam)], "i long, j long, v double")
    found, x = eigen.smallest(entries, 4)
    assert np.allclose([f["eigenvalue"] for f in found], lam[:4], atol=1e-9) and eigen.orthonormality_error(x) < 1e-10


def test_eigenpairs_of_one_value(spark):
    entries = spark.createDataFrame([(i, i, 2.0) for i in range(30)], "i long, j long, v double")
    found, x = eigen.smallest(entries, 3)
    assert np.allclose([f["eigenvalue"] for f in found], 2) and eigen.orthonormality_error(x) < 1e-10


def plain_geodesic(n, edges, k, before):
    near = {i: [] for i in range(n)}
    for a, b, d2 in edges:
        near[a].append((b, d2**0.5))
        near[b].append((a, d2**0.5))
    out = {}
    for s in range(n):
        done, heap = {}, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = d
            for w, length in near[v]:
                heapq.heappush(heap, (d + length, w))
        good = sorted((d, v) for v, d in done.items() if (v < s if before else v != s))[:k]
        for rank, (d, v) in enumerate(good, 1):
            out[s, rank] = (v, round(d, 9))
    return out


@pytest.mark.parametrize("before", [False, True])
def test_geodesic_neighbours_equal_dijkstra(spark, before):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)): float(w) for (a, b), w in zip(rng.integers(0, 60, (110, 2)), rng.random(110), strict=True) if a < b}
    edges |= {(i, i + 1): 0.01 for i in range(60, 80)}  # a long chain apart from the rest
    rows = [(a, b, w) for (a, b), w in edges.items()]
    order = spark.range(81).select(F.col("id").alias("node"), F.col("id").alias("place")) if before else None
    got = graph.geodesic_knn(spark.createDataFrame(rows, "src long, dst long, d2 double"), 4, order).collect()
    want = plain_geodesic(81, rows, 4, before)
    assert {(r.source, r.rank): (r.node, round(r.d, 9)) for r in got} == want


@pytest.mark.parametrize("before", [False, True])
def test_geodesic_neighbours_across_blocks(spark, monkeypatch, before):
    monkeypatch.setattr(graph, "BLOCK", 20)  # five blocks: paths leave them and come back
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)): float(w) for (a, b), w in zip(rng.integers(0, 80, (150, 2)), rng.integers(0, 4, 150) / 4, strict=True) if a < b}
    edges |= {(i, i + 1): 0.25 for i in range(80, 95)}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    order = spark.range(96).select(F.col("id").alias("node"), F.col("id").alias("place")) if before else None
    table, want = spark.createDataFrame(rows, "src long, dst long, d2 double"), plain_geodesic(96, rows, 4, before)
    runs = spark.range(96).select(F.col("id").alias("node"), F.floor(F.col("id") / 32).cast("int").alias("block"))
    for blocks in (None, runs):
        got = graph.geodesic_knn(table, 4, order, blocks).collect()
        assert {(r.source, r.rank): (r.node, round(r.d, 9)) for r in got} == want


def test_long_paths_take_rounds_by_blocks_and_not_by_hops(spark, monkeypatch):
    calls, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="part": (calls.append(name), plain(df, name))[1])
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("d2"))
    order = spark.range(61).select(F.col("id").alias("node"), (60 - F.col("id")).alias("place"))
    got = {(r.source, r.rank): r.node for r in graph.geodesic_knn(chain, 2, order).collect()}
    assert got[0, 1] == 1 and got[58, 2] == 60 and len(got) == 119 and len(calls) < 10


def test_dissolving_speckles(spark):
    cells = {(x, 0): (1 if x < 6 else 2) for x in range(12)} | {(x, 1): 2 for x in range(3)} | {(20, 20): 3, (22, 22): 3}
    rows = [(i, lab, float(x), float(y)) for i, ((x, y), lab) in enumerate(cells.items())]
    nodes = spark.createDataFrame(rows, "id long, label long, x double, y double")
    e = spatial.adjacency(nodes, "id", ["x", "y"], spatial.half_neighbourhood(2))
    got = {r.id: r for r in graph.dissolve(nodes, e, "id", "label", ["x", "y"], 4, 0.2).collect()}
    # the three cells of label 2 above label 1 go to their neighbours; of two lone cells of label 3 the one with the smaller root stays
    assert [got[i].new_label for i in (0, 6, 12, 13, 14, 15, 16)] == [0, 1, 0, 0, 0, 2, 2]
    assert sorted(i for i, r in got.items() if r.dissolved) == [12, 13, 14, 16]


def exact_gp(x, y, new, scale, noise, nu):
    d = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    k = local_gp.matern(d(x, x) / scale, nu) + noise * np.eye(len(x))
    cross, n, gap = local_gp.matern(d(new, x) / scale, nu), len(x), y - y.mean()
    s2 = gap @ np.linalg.solve(k, gap) / n
    score = -0.5 * (n * np.log(s2) + np.linalg.slogdet(k)[1] + n + n * np.log(2 * np.pi))
    return y.mean() + cross @ np.linalg.solve(k, gap), s2 * (1 + noise - (cross * np.linalg.solve(k, cross.T).T).sum(1)), score


def test_all_rows_as_neighbours_give_the_exact_process(spark):
    rng = np.random.default_rng(5)
    x, new = rng.random((40, 2)), rng.random((9, 2))
    y = {"a": np.sin(4 * x[:, 0]) + 0.1 * rng.normal(size=40), "b": rng.normal(size=40)}
    train, names = frame(spark, x, **y)
    asked, _ = frame(spark, new)
    order = local_gp.preceding(train, "id", names, 39)
    assert order.count() == 40 * 39 // 2
    fitted = local_gp.fit(train, order, "id", names, ["a", "b"], [0.1, 0.5, 2.0], [0.01, 0.3, 3.0], 1.5)
    near = knn_tree.tree_knn(asked, train, "id", names, 40)
    got = {(r.id, r.channel): r for r in local_gp.predict(asked, near, train, "id", names, fitted, 1.5).collect()}
    for f in fitted:
        every = {(s, n): exact_gp(x, y[f["channel"]], new, s, n, 1.5) for s in (0.1, 0.5, 2.0) for n in (0.01, 0.3, 3.0)}
        best = max(every, key=lambda g: every[g][2])
        assert (f["scale"], f["noise"]) == best and abs(f["log_likelihood"] - every[best][2]) < 1e-6
        mean, variance, _ = every[best]
        for i in range(9):
            r = got[i, f["channel"]]
            assert abs(r.mean - mean[i]) < 1e-8 and abs(r.variance - variance[i]) < 1e-8


def test_few_neighbours_come_close_and_rows_without_any_get_the_mean(spark):
    rng = np.random.default_rng(6)
    x = rng.random((300, 2))
    train, names = frame(spark, x, a=np.sin(5 * x[:, 0]) * np.cos(3 * x[:, 1]))
    order = local_gp.preceding(train, "id", names, 8)
    sizes = {r["src"]: r["count"] for r in order.groupBy("src").count().collect()}
    assert max(sizes.values()) <= 8 and len(sizes) == 299
    fitted = local_gp.fit(train, order, "id", names, ["a"], [0.2, 0.6], [1e-4, 1e-2])
    new = rng.random((20, 2))
    asked, _ = frame(spark, new)
    near = knn_tree.tree_knn(asked, train, "id", names, 8)
    got = {r.id: r.mean for r in local_gp.predict(asked, near, train, "id", names, fitted).collect()}
    assert max(abs(got[i] - np.sin(5 * v[0]) * np.cos(3 * v[1])) for i, v in enumerate(new)) < 0.05
    alone = local_gp.predict(asked.limit(1), near.limit(0), train, "id", names, fitted).first()
    assert abs(alone["mean"] - fitted[0]["mean"]) < 1e-12 and abs(alone["variance"] - fitted[0]["variance"] * (1 + fitted[0]["noise"])) < 1e-12
    assert local_gp.fit(train.limit(0), order.limit(0), "id", names, ["a"], [1.0], [1.0]) == []


def test_neighbours_along_a_graph_condition_the_process(spark):
    # a horseshoe: its two ends lie side by side, but far apart along it
    turn = np.linspace(0, 2 * np.pi * 0.97, 120)
    x = np.column_stack([np.cos(turn), np.sin(turn)])
    train, names = frame(spark, x[::2], a=turn[::2])
    e = spatial.edges_from(knn_tree.tree_knn(train, train, "id", names, 2, same=True))
    e = e.where("abs(src - dst) < 30")
    before, near = local_gp.along_graph(train, "id", e.cache(), 6)
    assert all(abs(r.src - r.dst) < 30 for r in near.collect()) and before.groupBy("src").count().agg(F.max("count")).first()[0] <= 6
    fitted = local_gp.fit(train, before, "id", names, ["a"], [0.3, 1.0], [1e-3, 1e-2])
    new, _ = frame(spark, x[1::2])
    got = {r.id: r.mean for r in local_gp.predict(new, local_gp.snapped(new, train, "id", names, near), train, "id", names, fitted).collect()}
    assert len(got) == 60 and max(abs(got[i] - turn[1::2][i]) for i in range(60)) < 0.3
