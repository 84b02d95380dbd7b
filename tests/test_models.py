"""Transport, sparse tasks, experts, enhanced images and the guard, each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import enhance, experts, guard, sparse_gp, transport


def plain_transport(x, y, eps, rounds=3000):
    c = ((x[:, None] - y[None]) ** 2).sum(-1)
    k, a, b = np.exp(-c / eps), np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y))
    v = np.ones(len(y))
    for _ in range(rounds):
        u = a / (k @ v)
        v = b / (k.T @ u)
    return u[:, None] * k * v[None, :], c


def test_large_sections_meet_in_moments(spark, monkeypatch):
    monkeypatch.setattr(transport, "BLOCK", 700)
    rng = np.random.default_rng(3)
    x, y = rng.random((2500, 2)) * 1.2 - 0.5, rng.random((1500, 2)) * [1.0, 1.3]
    rows = [(s, 10000 * s + i, *map(float, v)) for s, p in ((4, x), (5, y)) for i, v in enumerate(p)]
    points = spark.createDataFrame(rows, "s long, id long, x double, y double")
    solved = transport.Transport(points, "s", "id", ["x", "y"], spark.createDataFrame([(4, 5), (5, 6)], "a long, b long"), 0.5, tolerance=1e-10)
    assert solved.cells
    plan, c = plain_transport(x, y, 0.5, rounds=300)
    got = sorted(solved.carried().collect(), key=lambda r: r.key)
    assert [r.key for r in got] == [40000 + i for i in range(2500)]
    assert np.allclose([r.mass * 2500 for r in got], 1.0, atol=1e-9) and np.allclose([r.cost for r in got], (plan * c).sum(1), rtol=1e-8)
    assert np.allclose([[r.y0, r.y1] for r in got], (plan @ y) / plan.sum(1)[:, None], atol=1e-8)


@pytest.mark.parametrize("block", [7, 2048])
def test_transport_equals_plain_scaling_and_keeps_marginals(spark, monkeypatch, block):
    monkeypatch.setattr(transport, "BLOCK", block)
    rng = np.random.default_rng(1)
    sections = {0: rng.random((20, 2)), 1: rng.random((13, 2)) + 0.5, 2: rng.random((1, 2)), 3: rng.random((9, 2)) * 3}
    rows = [(s, 100 * s + i, *map(float, v)) for s, p in sections.items() for i, v in enumerate(p)] + [(3, 399, None, 1.0)]
    points = spark.createDataFrame(rows, "s long, id long, x double, y double")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 1), (None, 1)], "a long, b long")
    solved = transport.Transport(points, "s", "id", ["x", "y"], pairs, 0.3, tolerance=1e-8)
    got = solved.carried().collect()
    assert {(r.a, r.b) for r in got} == {(0, 1), (1, 2), (2, 3)}
    for a, b in ((0, 1), (1, 2), (2, 3)):
        plan, c = plain_transport(sections[a], sections[b], 0.3)
        mine = sorted((r for r in got if r.a == a), key=lambda r: r.key)
        assert np.allclose([r.mass for r in mine], 1 / len(sections[a]), atol=1e-6)
        assert np.allclose([r.cost for r in mine], (plan * c).sum(1), atol=1e-6)
        assert np.allclose([[r.y0, r.y1] for r in mine], (plan @ sections[b]) / plan.sum(1)[:, None], atol=1e-6)
    half = {r.key: (r.x, r.y) for r in transport.between(solved.carried(), points, "s", "id", ["x", "y"], 0.0).collect()}
    assert np.allclose(half[0], sections[0][0])


def test_transport_gives_up_loudly(spark):
    points = spark.createDataFrame([(0, 0, 0.0), (0, 1, 9.0), (1, 2, 0.0), (1, 3, 9.0), (1, 4, 5.0)], "s long, id long, x double")
    with pytest.raises(RuntimeError, match="marginals"):
        transport.Transport(points, "s", "id", ["x"], spark.createDataFrame([(0, 1)], "a long, b long"), 1e-3, tolerance=0.0, rounds=5)


def frame(spark, x, **columns):
    rows = [(i, *map(float, v), *[float(c[i]) for c in columns.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double" + "".join(f", {c} double" for c in columns)).repartition(3)


def test_all_rows_as_inducing_points_give_the_exact_posterior(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 2))
    tasks = {"a": np.sin(5 * x[:, 0]), "b": rng.normal(size=30)}
    df = frame(spark, x, **tasks)
    model = sparse_gp.SparseTasks(x, [0.4, 0.4], [1.0, 2.0], [0.1, 0.5]).fit(df, ["x", "y"], ["a", "b"])
    got = {(r.id, r.task): r for r in model.predict(df, "id").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / 0.4
    s = np.sqrt(5) * d
    k = (1 + s + s * s / 3) * np.exp(-s)
    for task, s2, noise in (("a", 1.0, 0.1), ("b", 2.0, 0.5)):
        whole = s2 * k + noise * np.eye(30)
        mean, var = s2 * k @ np.linalg.solve(whole, tasks[task]), s2 + noise - (s2 * k * np.linalg.solve(whole, s2 * k).T).sum(1)
        assert np.allclose([got[i, task].mean for i in range(30)], mean, atol=1e-5) and np.allclose([got[i, task].variance for i in range(30)], var, atol=1e-5)
        evidence = -0.5 * (tasks[task] @ np.linalg.solve(whole, tasks[task]) + np.linalg.slogdet(whole)[1] + 30 * np.log(2 * np.pi))
        assert abs(model.bounds[-1]["ab".index(task)] - evidence) < 1e-3


def test_the_bound_rises_with_every_step_and_with_more_inducing_points(spark):
    rng = np.random.default_rng(3)
    x = rng.random((80, 2))
    df = frame(spark, x, a=np.sin(5 * x[:, 0]) + 0.1 * rng.normal(size=80))
    one = lambda n, steps, step: sparse_gp.SparseTasks(x[:n], [0.4, 0.4], [1.0], [0.05]).fit(df, ["x", "y"], ["a"], steps, step).bounds
    slow = [b[0] for b in one(12, 8, 0.4)]
    assert all(b >= a for a, b in zip(slow, slow[1:], strict=False))
    exact = one(12, 1, 1.0)[0][0]
    assert slow[-1] <= exact + 1e-6 and exact - slow[-1] < 0.05 * abs(exact) and one(30, 1, 1.0)[0][0] > exact
    with pytest.raises(ValueError):
        sparse_gp.SparseTasks(np.zeros((sparse_gp.MOST_INDUCING + 1, 2)), [1, 1], [1.0], [1.0])


def plain_em_likelihood(model, x, y):
    out = 0.0
    for v, t in zip(x, y, strict=True):
        total = 0.0
        for e in range(model.experts):
            gate = np.prod(np.exp(-0.5 * (v - model.mean[e]) ** 2 / model.var[e]) / np.sqrt(2 * np.pi * model.var[e]))
            at = model.weights[e] @ np.concatenate([[1], v])
            total += model.share[e] * gate * np.exp(-0.5 * (t - at) ** 2 / model.noise[e]) / np.sqrt(2 * np.pi * model.noise[e])
        out += np.log(total)
    return out


def test_experts_rise_in_likelihood_and_find_two_regimes(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, 2))
    y = np.where(x[:, 0] < 0.5, 3 * x[:, 1], 5 - 4 * x[:, 1]) + 0.05 * rng.normal(size=400)
    df = frame(spark, x, t=y)
    model = experts.MixtureOfExperts(2, rounds=40, tolerance=0.0).fit(df, ["x", "y"], "t")
    up = model.likelihoods
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(up, up[1:], strict=False)) and up[-1] > up[0]
    short = experts.MixtureOfExperts(2, rounds=1).fit(df, ["x", "y"], "t")
    again = experts.MixtureOfExperts(2, rounds=2, tolerance=0.0).fit(df, ["x", "y"], "t")
    assert abs(again.likelihoods[1] - plain_em_likelihood(short, x, y)) < 1e-6 * abs(again.likelihoods[1])
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert np.mean([(got[i] - y[i]) ** 2 for i in range(400)]) < 0.3 * y.var()
    with pytest.raises(ValueError):
        experts.MixtureOfExperts(2).fit(df.limit(0), ["x", "y"], "t")


def greedy(image, share, most, stop):
    left = np.fft.fft2(image)
    kept, total = np.zeros_like(left), (np.abs(left) ** 2).sum() + 1e-12
    for _ in range(min(most, max(1, int(share * left.size)))):
        at = np.unravel_index(np.abs(left).argmax(), left.shape)
        kept[at], left[at] = left[at], 0
        if (np.abs(left) ** 2).sum() / total < stop:
            break
    return np.real(np.fft.ifft2(kept))


def test_enhanced_images(spark):
    rng = np.random.default_rng(5)
    for shape in ((8, 8), (7, 9), (16, 5)):
        image = rng.normal(size=shape)
        for share, most, stop in ((0.1, 64, 0.05), (1.0, 9, 0.0), (1.0, 999, 0.3)):
            assert np.allclose(enhance.anti_leakage(image, share, most, stop), greedy(image, share, most, stop), atol=1e-9)
        assert np.allclose(enhance.envelope_2d(image * 3), enhance.envelope_2d(image) * 3)
    wave = np.cos(2 * np.pi * 3 * np.arange(32) / 32)
    assert np.allclose(enhance._analytic(np.tile(wave[:, None], (1, 4)), 0).imag[:, 0], np.sin(2 * np.pi * 3 * np.arange(32) / 32), atol=1e-9)
    rows = [("a", i, float(rng.random()), float(rng.random()), float(rng.normal())) for i in range(60)] + [("b", 90, 0.0, 0.0, 7.0), (None, 91, 0.5, 0.5, 8.0), ("a", 92, None, 0.1, 9.0)]
    points = spark.createDataFrame(rows, "s string, id long, u double, v double, c double")
    got = {r.id: r.c for r in enhance.enhance(points, "s", "u", "v", ["c"], 8, "anti-leakage").collect()}
    mine = [r for r in rows if r[0] == "a" and r[2] is not None]
    u, v = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
    i, j = (np.floor((w - w.min()) / (w.max() - w.min()) * 7).astype(int) for w in (u, v))
    image, n = np.zeros((8, 8)), np.zeros((8, 8))
    np.add.at(image, (i, j), [r[4] for r in mine])
    np.add.at(n, (i, j), 1)
    want = enhance.anti_leakage(np.divide(image, n, out=np.zeros_like(image), where=n > 0))
    assert np.allclose([got[r[1]] for r in mine], want[i, j]) and (got[90], got[91], got[92]) == (7.0, 8.0, 9.0)


def test_a_streak_of_bad_batches_stops_the_run(spark, tmp_path):
    watch = guard.Guard(["v"], share=0.5, most=3)
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    for values, streak in (((1.0, 2.0), 0), ((float("nan"), None), 1), ((1.0, float("inf")), 0), ((float("inf"),), 1), ((None, None, 1.0), 2), ((), 0), ((None,), 1), ((None,), 2)):
        watch.watch(batch(*values)).write.format("noop").mode("overwrite").save()
        seen = watch.settle()
        assert (seen["n"], seen["streak"]) == (len(values), streak)
    watch.report(spark, str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 5
    with pytest.raises(guard.BadStreak):
        watch.watch(batch(None)).count()
        watch.settle()
    with pytest.raises(ValueError):
        guard.Guard(["v"]).settle()


def test_a_guarded_stream(spark, tmp_path):
    spark.createDataFrame([(1.0,), (None,)], "v double").write.parquet(str(tmp_path / "in"))
    watch, sizes = guard.Guard(["v"], share=0.9), []
    stream = spark.readStream.schema("v double").parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(watch.for_each_batch(lambda df, i: sizes.append(df.count()))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    query.awaitTermination(60)
    assert sizes == [2] and watch.step == 1 and watch.streak == 0


def plain_convolution(model, x, edges, neighbours, n, y, weights, shift):
    """Loss with the best read-out, by dense matrices."""
    mid = np.sort([d for _, _, d in edges])[(len(edges) - 1) // 2]
    w = np.eye(n)
    for a, b, d in edges:
        w[a, b] = w[b, a] = np.exp(-d / mid)
    s = w / np.sqrt(w.sum(1)[:, None] * w.sum(1)[None])
    r = np.zeros((len(y), n))
    for i, j, d in neighbours:
        r[i, j] = 1 / (d**0.5 + 1e-8)
    r /= r.sum(1, keepdims=True)
    z = np.column_stack([r @ s @ np.maximum(s @ x @ weights + shift, 0), np.ones(len(y))])
    ridge = model.penalty * len(y) * np.diag([1.0] * model.hidden + [1e-12])
    out = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    return ((z @ out - y) ** 2).mean() + model.penalty * (out[:-1] ** 2).sum(), z @ out


def test_graph_convolution_gradient_and_training(spark):
    from lodestrata.operators import convolution

    rng = np.random.default_rng(6)
    n, m = 30, 40
    x, at = rng.random((n, 2)), rng.random((m, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    edges = sorted({(min(i, int(j)), max(i, int(j)), float(d[i, j])) for i in range(n) for j in np.argsort(d[i])[1:4]})
    far = ((at[:, None] - x[None]) ** 2).sum(-1)
    neighbours = [(i, int(j), float(far[i, j])) for i in range(m) for j in np.argsort(far[i])[:3]]
    y = np.abs(at[:, 0] - 0.5) + 0.3 * at[:, 1]
    nodes = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node long, a double, b double")
    e, k = spark.createDataFrame(edges, "src long, dst long, d2 double"), spark.createDataFrame(neighbours, "src long, dst long, d2 double")
    train = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, y double")
    model = convolution.TrainedConvolution(3, rounds=12).prepare(nodes, "node", ["a", "b"], e, k)
    loss, by_w, by_c = model.evaluate(train)
    plain = lambda w, c: plain_convolution(model, x, edges, neighbours, n, y, w, c)[0]
    assert abs(loss - plain(model.weights, model.shift)) < 1e-9
    for place in np.ndindex(by_w.shape):
        step = np.zeros_like(by_w)
        step[place] = 1e-6
        assert abs((plain(model.weights + step, model.shift) - plain(model.weights - step, model.shift)) / 2e-6 - by_w[place]) < 1e-6
    for j in range(3):
        step = np.eye(3)[j] * 1e-6
        assert abs((plain(model.weights, model.shift + step) - plain(model.weights, model.shift - step)) / 2e-6 - by_c[j]) < 1e-6
    model.fit(train, "i", "y")
    assert min(model.losses) < 0.9 * model.losses[0]
    got = {r.i: r.prediction for r in model.predict().collect()}
    assert np.allclose([got[i] for i in range(m)], plain_convolution(model, x, edges, neighbours, n, y, model.weights, model.shift)[1], atol=1e-6)
    # smoothing alone is the same read-out of the smoothed features without a layer between
    mse = np.mean([(got[i] - y[i]) ** 2 for i in range(m)])
    flat = plain_convolution(convolution.TrainedConvolution(2), x, edges, neighbours, n, y, np.eye(2), np.zeros(2))[1]
    assert mse < ((flat - y) ** 2).mean()


@pytest.mark.parametrize("many", [0, 99])
def test_spectral_regression_of_many_modes(spark, monkeypatch, many):
    from lodestrata.operators import learn

    monkeypatch.setattr(learn.SpectralRegression, "MANY", many)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 5))
    y = x @ rng.normal(size=5) + 0.1 * rng.normal(size=50)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    names = [f"f{k}" for k in range(5)]
    df = spark.createDataFrame([*rows, (50, 1.0, None, 0.0, 0.0, 0.0, None)], "id long, " + ", ".join(f"{n} double" for n in [*names, "y"]))
    density = [1.0, 0.5, 0.2, 2.0, 1.0]
    got = {r.id: r for r in learn.SpectralRegression(density, 0.3).fit(df, names, "y").predict(df, "mean", "variance").collect()}
    a = x.T @ x
    a[0, 0] += 1.0  # what the row with nulls still says
    cov = np.linalg.inv(a / 0.3 + np.diag(1 / np.array(density)))
    assert np.allclose([got[i]["mean"] for i in range(50)], x @ cov @ x.T @ y / 0.3)
    assert np.allclose([got[i]["variance"] for i in range(50)], 0.3 + ((x @ cov) * x).sum(1))
    assert got[50]["mean"] is None and got[50]["variance"] is None


def test_array_files_in_slices(spark, tmp_path):
    from lodestrata.sources import readers

    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(25, 2, 2)), np.asfortranarray(rng.integers(0, 9, (7, 4)).astype("int16"))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    np.save(tmp_path / "c.npy", np.zeros((0, 4)))
    df = readers.array_slices(spark, f"file://{tmp_path}/*.npy", list("pqrs"), rows=4)
    assert df.rdd.getNumPartitions() == 7 + 2
    got = sorted((r.file.rsplit("/", 1)[1], r.row_id, r.p, r.q, r.r, r.s) for r in df.collect())
    want = [("a.npy", i, *map(float, v.ravel())) for i, v in enumerate(a)] + [("b.npy", i, *map(float, v)) for i, v in enumerate(b)]
    assert got == want
    assert readers.array_slices(spark, f"{tmp_path}/none*.npy", ["x"]).count() == 0
    with pytest.raises(Exception, match="columns"):
        readers.array_slices(spark, f"{tmp_path}/a.npy", ["x"]).count()
