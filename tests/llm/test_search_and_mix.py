"""Top-k search and mixing against plain versions of the same thing."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import mixing, topk_search


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 24)).round(2)
    m[100:140] = m[7]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(m)]
    rows += [(900, None, "q"), (950, [1.0, None], "q"), (1000, [float("nan")] * 24, "q"), (1050, [float("inf")] * 24, "q"), (1100, [], "q"), (1150, [0.5, 1.0], "q"), (None, [1.0] * 24, "q"), (7, m[7].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(5)
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = list(range(300)) + [7]
    q = np.floor(np.vstack([m, m[7]]) * 256).astype(np.int64)
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for query_id, found in got.items():
        scores = sorted((-int(q[query_id] @ q[k]), i) for k, i in enumerate(ids) if i != query_id)[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_top_k_of_few_none_and_huge(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1e30])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk_search.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 2**63 - 1), (2, 1, 256 * 512)]
    assert topk_search.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, w_rest = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        t = {s: fixed.get(s, rest * w[s] / w_rest if w_rest else 0) for s in names}
        over = [s for s in names if s not in fixed and t[s] > most * sizes[s]]
        if not over:
            return t
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, "é": 7, "Z": 300, None: 20}, {"a": 0, "b": 5}, {"x": 9}, {"a": 1, "b": 1, "c": 1, "d": 4000}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def near_targets(rows, out, slack=0.002, least=3):
    """Sizes, words taken and targets by source, checked against plain ones."""
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = plain_targets(sizes)
    assert len(out) == len(rows)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(least, slack * target[s]), (s, taken[s], target[s])
    return taken


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        n = int(rng.lognormal(4, 1.2))
        source = "hot" if i % 3 == 0 else [None, "s1", "s2", "s3", "tiny"][i % 5] if i % 97 else "tiny"
        rows.append((i, " ".join(["w"] * n), source, "clash"))
    rows += [(5000, None, "s1", "c"), (5001, "", "s1", "c"), (None, "a b c", "s2", "c"), (3, rows[3][1], rows[3][2], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(6)
    out = mixing.mix(df).collect()
    near_targets(rows, out)
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(out) == key(again)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0


def test_rows_that_are_equal_are_taken_in_part(spark):
    """Three hundred equal rows without an id, beside as many with ids: each source within one document of its target."""
    words = " ".join(["w"] * 10)
    rows = [(None, words, "a", k % 7) for k in range(300)] + [(k, words, "b", 0) for k in range(300)] + [(9, words, "c", k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    taken = near_targets(rows, mixing.mix(df).collect(), slack=0.0, least=9.9)
    assert taken["a"] and taken["c"] > 400
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.source, r.taken) for r in again) == sorted((str(r.doc_id), r.source, r.taken) for r in mixing.mix(df).collect())
    mixed = mixing.take(df).groupBy("source").count().collect()
    assert {r.source: r["count"] * 10 for r in mixed} == taken


def test_no_column_of_a_table_is_touched_by_the_mix(spark):
    internal = [c + tail for c in "own about who nth id n part order before extra size copies of_source".split() for tail in ("", "_")]
    names = [f"_ls_{c}" for c in internal] + ["_of_source", "_s", "x", "f", "gap", "place", "b", "a.b", "size", "whole", "again"]
    fields = ", ".join(f"`{c}` int" for c in names)
    rows = [(i if i % 5 else 1, "w " * (i % 13), ["a", None][i % 2], *range(i, i + len(names))) for i in range(60)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {fields}")
    copies = {}
    for r in mixing.take(df).collect():
        assert tuple(r) in rows
        copies[tuple(r)] = copies.get(tuple(r), 0) + 1
    mixed = mixing.mix(df).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).collect()
    for m in mixed:
        assert m.n == sum(n for r, n in copies.items() if (r[0], r[2], len(r[1].split())) == (m.doc_id, m.source, m.size))


def test_documents_are_taken_as_often_as_their_inclusion_probabilities_say(spark):
    """Sources of the same documents under other ids are draws of the same sample."""
    rng = np.random.default_rng(8)
    sizes, draws = [int(n) + 1 for n in rng.lognormal(3.5, 0.9, 200)], 150
    docs = spark.createDataFrame([(k, " ".join(["w"] * n)) for k, n in enumerate(sizes)], "k long, text string")
    many = docs.crossJoin(spark.range(draws)).select((F.col("id") * 1000 + F.col("k")).alias("doc_id"), "text", F.concat(F.lit("s"), F.col("id")).alias("source"))
    got = mixing.mix(many, weights=(1,)).groupBy((F.col("doc_id") % 1000).alias("k")).agg(F.avg("copies").alias("m"), F.max("size").alias("size")).collect()
    # expected copies: the level where the words that are expected are the source's own
    low, high = 0.0, 3.0
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(3, c * n.bit_length()) * n for n in sizes) < sum(sizes) else (low, c)
    expected = {n: min(3, c * n.bit_length()) for n in sizes}
    assert max(expected.values()) > 1.3 * min(expected.values())
    by_class = {}
    for r in got:
        by_class.setdefault(r.size.bit_length(), []).append(r.m - expected[r.size])
    # a class whose every document is there in 150 draws: 0.04 is one deviation of a single document
    for x, off in by_class.items():
        assert abs(np.mean(off)) < 0.03 + 0.12 / math.sqrt(len(off)), (x, len(off), np.mean(off))
