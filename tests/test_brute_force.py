"""Registered queries without SQL against plain versions over the same whole tables."""

import numpy as np
import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)


def query(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def grid(spark):
    """lineitem's mean quantity on the volume of the registered queries, NaN where no row is."""
    v = np.full((8, 16, 16, 2), 0.0)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber", "l_suppkey", "l_partkey", "l_quantity").collect():
        v[r[0], r[1] % 16, r[2] % 16] += (float(r[3]), 1)
    with np.errstate(invalid="ignore"):
        return v[..., 0] / v[..., 1]


def test_hessians(spark):
    v = grid(spark)

    def at(z, y, x, own):
        inside = 0 <= z < 8 and 0 <= y < 16 and 0 <= x < 16
        return v[z, y, x] if inside and not np.isnan(v[z, y, x]) else own

    weights = {d: np.exp(-d * d / 2) for d in range(-3, 4)}
    got = {(r.z, r.y, r.x): r for r in query(spark, "G22_hessian_and_deviation")}
    cells = np.argwhere(~np.isnan(v))
    assert len(got) == len(cells)
    for p in cells[::17].tolist():
        own, h = v[tuple(p)], np.zeros((3, 3))
        step = np.eye(3, dtype=int)
        for a in range(3):
            for b in range(3):
                f = lambda s, t: at(*(np.array(p) + s * step[a] + t * step[b]), own)  # noqa: B023, E731
                h[a, b] = f(1, 0) - 2 * own + f(-1, 0) if a == b else (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / 4
        r = got[tuple(p)]
        assert np.allclose([r.e0, r.e1, r.e2], np.linalg.eigvalsh(h), atol=2e-6)
        sums = np.zeros(3)
        for dz in weights:
            for dy in weights:
                for dx in weights:
                    q = at(p[0] + dz, p[1] + dy, p[2] + dx, np.nan)
                    if not np.isnan(q):
                        sums += weights[dz] * weights[dy] * weights[dx] * np.array([1, q, q * q])
        assert np.isclose(r.deviation, np.sqrt(max(0, sums[2] / sums[0] - (sums[1] / sums[0]) ** 2)), atol=1e-5)


def test_envelopes(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity").collect():
        rows.setdefault((r[0] % 16, r[1] % 64), []).append(float(r[2]))
    got = {(r.y, r.x): r.e for r in query(spark, "G29_section_envelope")}
    assert got.keys() == rows.keys()
    for y in range(16):
        xs = sorted(x for a, x in rows if a == y)
        v = np.array([np.mean(rows[y, x]) for x in xs])
        v, n = v - v.mean(), len(v)
        # the analytic signal by its definition: no negative frequencies, positive ones twice
        k = np.arange(n)
        spectrum = np.exp(-2j * np.pi * np.outer(k, k) / n) @ v
        gain = np.where(k == 0, 1.0, np.where(2 * k < n, 2.0, np.where(2 * k == n, 1.0, 0.0)))
        want = np.abs(np.exp(2j * np.pi * np.outer(k, k) / n) @ (spectrum * gain)) / n
        assert np.allclose([got[y, x] for x in xs], want, atol=2e-5)


def test_planes(spark, embeddings):
    ids, labels, e = embeddings
    got = {r.id: r for r in query(spark, "G26_G27_plane_projection")}
    assert len(got) == len(ids)
    for label in np.unique(labels):
        p = e[labels == label][:, :3]
        axes = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, ::-1][:, :2]
        want = (p - p.mean(axis=0)) @ axes
        mine = np.array([(got[i].u, got[i].v) for i in ids[labels == label]])
        assert np.allclose(np.abs(mine), np.abs(want), atol=2e-6)


def test_spectrum(spark):
    from lodestrata.plans.q_stats import CHANNELS

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(*CHANNELS).collect()
    lam = np.sort(np.linalg.eigvalsh(np.corrcoef(np.array(rows, dtype=float).T)))[::-1]
    got = query(spark, "A20_T8_spectrum")[0]
    share = np.cumsum(lam) / lam.sum()
    assert np.isclose(got.pc1_share, share[0], atol=1e-5) and np.isclose(got.participation_ratio, lam.sum() ** 2 / (lam**2).sum(), atol=1e-5)
    assert got.n90 == (share < 0.9).sum() + 1 and got.n95 == (share < 0.95).sum() + 1


def test_gaussian_processes(spark, embeddings):
    ids, labels, e = embeddings
    got = {r.id: r for r in query(spark, "G33_M10_M16_U5_gp_by_channel")}
    assert sorted(got) == [i for i in ids.tolist() if i % 5 == 0]
    gram = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * 0.2 * 0.2))
    for label in np.unique(labels):
        train, test = (labels == label) & (ids % 5 != 0), (labels == label) & (ids % 5 == 0)
        if not train.any() or not test.any():
            continue
        x, y, noise = e[train][:, :2], e[train][:, 2], got[ids[test][0]].noise
        want = y.mean() + gram(e[test][:, :2], x) @ np.linalg.inv(gram(x, x) + noise * np.eye(len(x))) @ (y - y.mean())
        assert np.allclose([got[i].prediction for i in ids[test]], want, atol=2e-4)


@pytest.mark.parametrize("name", ["M3_boosting", "M5_perceptron"])
def test_learners_are_no_worse_than_the_mean(spark, name):
    """The price of these tables does not depend on what the learners see, so there is nothing to gain over the mean."""
    y = np.array(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice").collect(), dtype=float)
    row = query(spark, name)[0]
    assert row.n == len(y) and row.rmse <= y.std() + 50


def test_a_hashed_field_beats_the_mean(spark, embeddings):
    _, _, e = embeddings
    row = query(spark, "M12_hash_field")[0]
    assert row.n == len(e) and row.rmse < 0.5 * (2 * e[:, 0] - e[:, 1]).std()
