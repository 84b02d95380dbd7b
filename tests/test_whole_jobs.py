"""Queries that take every row of their tables."""

from collections import Counter

import numpy as np
import pytest

from lodestrata import catalog
from lodestrata.operators import volume

SF = "/root/testdata/sf0.001"


def query(spark, name):
    return catalog.queries()[name](spark, SF)


def test_every_row_has_a_density(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").collect()
    q, p = (np.array([float(r[k]) for r in rows]) for k in (4, 5))
    bins = list(zip(*[np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 20), 19) for v in (q, p)]))
    n = Counter(bins)
    got = Counter(tuple(r) for r in query(spark, "A51_W13_histogram_density").collect())
    assert got == Counter((*r[:4], n[b]) for r, b in zip(rows, bins))


@pytest.mark.parametrize("name", ["M3_boosting", "M5_perceptron"])
def test_every_row_is_predicted(spark, name):
    assert query(spark, name).first().n == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_the_nearest_border_is_searched_among_all_points(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    at, label = np.array([r.embedding[:3] for r in e], dtype=float), np.array([r.label for r in e])
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    d2[label[:, None] == label[None]] = np.inf
    got = {r.id: r.d2 for r in query(spark, "G20_A50_border_distance").collect()}
    assert len(got) == len(e) and all(abs(got[r.vec_id] - v) < 1e-6 for r, v in zip(e, d2.min(1)))


def test_voxels_hold_every_row(spark):
    from lodestrata.plans.q_volume import voxels

    want = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber", "l_suppkey", "l_partkey", "l_quantity").collect():
        want.setdefault((r[0], r[1] % 16, r[2] % 16), []).append(float(r[3]))
    got = {(r.z, r.y, r.x): float(r.v) for r in voxels(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("name", ["G21_surface_depth", "G22_gaussian_smoothing", "G22_gradient_size", "G22_hessian_and_deviation"])
def test_every_voxel_has_a_value(spark, name):
    cells = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_linenumber", "l_suppkey % 16", "l_partkey % 16").distinct().count()
    assert query(spark, name).count() == cells


def test_only_closed_holes_are_filled(spark):
    cube = [(z, y, x) for z in range(3) for y in range(3) for x in range(3) if (z, y, x) != (1, 1, 1)]
    fill = lambda cells: volume.fill_holes(spark.createDataFrame(cells, "z int, y int, x int")).count()
    assert fill(cube) == 27 and fill([c for c in cube if c != (0, 1, 1)]) == 25


def test_geodesics_go_on_until_nothing_changes(spark, tmp_path):
    line = [(k, 0, [0.11 * k] + [0.0] * 63) for k in range(30)]
    spark.createDataFrame(line, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.node: r.d for r in catalog.queries()["G18_geodesic"](spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(24)) and all(abs(d - 0.11 * k) < 1e-4 for k, d in got.items())


def test_parcels_are_those_of_all_planes(spark):
    got = query(spark, "G19_contiguous_parcels").collect()
    cells = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey % 32", "l_suppkey % 32", "l_linenumber").distinct().count()
    assert len(got) == cells and len({r.id % 8 for r in got if r.component == got[0].component}) > 1


def test_every_pair_of_suppliers_has_a_kernel(spark):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert query(spark, "G15_factor_kernels").select("a", "b").distinct().count() == n * n


def test_border_of_one_region_is_empty(spark, tmp_path):
    from lodestrata import catalog

    rows = [(p, 5 * s, 1 + p % 7, 1.0) for p in range(8) for s in range(4)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()
    assert found["G20_A50_border_field"](spark, str(tmp_path)).count() == 0
    assert tuple(found["G20_A50_border_summary"](spark, str(tmp_path)).first()) == (None, None, None, 0)


def test_knn_join_asks_for_every_vector(spark):
    from lodestrata import catalog

    sf = "/root/testdata/sf0.001"
    asked = catalog.queries()["J13_T5_knn_join"](spark, sf).select("src").distinct().count()
    assert asked == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_distance_prize_joins_no_pairs_by_bin(spark):
    from lodestrata import catalog

    plan = catalog.queries()["A39_distance_and_border_prize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of the points by place


def test_pairs_of_suppliers_are_made_in_many_tasks(spark, monkeypatch):
    from lodestrata.plans import q_volume

    monkeypatch.setattr(q_volume, "PAIRS", 500, raising=False)
    s = {r.s_suppkey: r for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    made = query(spark, "G15_factor_kernels")
    assert made.rdd.getNumPartitions() >= len(s) ** 2 // 500
    want = lambda a, b: np.exp(-((a.s_acctbal - b.s_acctbal) ** 2) / 2e6) * (1.0 if a.s_nationkey == b.s_nationkey else 0.3)
    rows = made.collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == len(s) ** 2 and all(abs(r.k - want(s[r.a], s[r.b])) < 1e-6 for r in rows)


def test_a_border_of_one_other_label_is_searched_to_its_end(spark):
    from lodestrata.operators import graph

    border = spark.createDataFrame([(1, 0, 0.0, 0.0)], "id long, side int, x double, y double")
    nodes = spark.createDataFrame([(2, 1, 1.0, 0.0), (3, 1, 40.0, 30.0), (4, 0, 5.0, 5.0), (5, None, 1.0, 1.0)], border.schema)
    assert {tuple(r) for r in graph.border_distance(nodes, border, "id", "side", ["x", "y"], 2.0).collect()} == {(2, 0, 1.0), (3, 0, 2500.0)}
    assert graph.border_distance(nodes, border.limit(0), "id", "side", ["x", "y"], 2.0).count() == 0
