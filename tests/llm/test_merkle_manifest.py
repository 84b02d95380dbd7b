"""The Merkle manifest against trees built by the rule in plain Python, over many ranges, fanouts and odd rows."""

import hashlib
import random
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import merkle_manifest as M
from lodestrata.llm.common import positions


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
        at //= fanout
    return out


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted tuples of the query's columns."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = mine, plain_levels([plain_leaf(r) for r in mine], fanout)
    top = plain_levels([trees[lang][1][-1][0] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        mine, levels = trees[lang]
        for at, r in enumerate(mine):
            path = plain_path(levels, at, fanout) + plain_path(top, k, fanout)
            x = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                x = (*r[:3], r[3] + 1, r[4])
            x = plain_leaf(x)
            for left, right in path:
                x = H(left, x, right)
            root = top[-1][0]
            out.append((r[0], levels[0][at], levels[-1][0], root, H("".join(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, p_pos long, key string, row int"


def odd_rows(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en"] * 6 + ["de", None, "", "-", "é", "\U0001f642"]), rng.choice([None, 3, 2**63 - 1]), rng.choice(["", None, "é", "word " * 9])) for i in range(n)]
    rows += [rows[3]] * 5 + [(None, "s", "en", 1, "x")] * 2 + [(4, "s", "en", 1, "y"), (4, "s", "en", 1, "x"), (-7, None, None, None, None), (n, "s", "fr", 0, "long " * 200000)]
    return rows


@pytest.fixture
def scattered(spark):
    """Ranges stay as many and as small as they are cut."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(spark, rows, path):
    spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in M.query(spark, str(path)).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("block", [2, 4096])
def test_the_query_equals_the_rule(scattered, tmp_path, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = odd_rows(120, block)
    got = written(scattered, rows, tmp_path)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    rows = [(5, None, None, None, None)]
    assert written(spark, rows, tmp_path / "one") == plain_manifest(rows)
    assert written(spark, [], tmp_path / "none") == []


@pytest.mark.parametrize("fanout", [3])
def test_other_fanouts_and_whole_siblings(scattered, fanout, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 10)
    rows = odd_rows(90, fanout)
    docs = scattered.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = M.manifest(docs, fanout, with_siblings=True).collect()
    want = plain_manifest(rows, fanout)
    assert sorted((str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got)) == sorted(str(w[:5]) for w in want)
    for r in got:
        x = r.leaf
        for s in r.siblings:
            x = H(s.left, x, s.right)
        assert x == r.root == r.folded_root


@pytest.mark.parametrize("fanout,n", [(2, 1), (2, 37), (3, 82)])
def test_stack_and_merge_give_every_node_once(scattered, fanout, n, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", fanout)
    items = scattered.createDataFrame([("k", i, H(str(i))) for i in range(n)], "key string, i long, digest string")
    got = M.nodes(positions(items, "key", [F.col("i")]), fanout).collect()
    want = plain_levels([H(str(i)) for i in range(n)], fanout)
    assert sorted((r.level, r.pos, r.digest) for r in got) == sorted((k, p, d) for k, level in enumerate(want) for p, d in enumerate(level))


def test_the_stack_holds_few_digests_and_leaves_only_edges():
    rng = random.Random(1)
    for fanout in (2, 3, 7):
        n = rng.randrange(50, 400)
        cuts = sorted({0, n, *rng.sample(range(1, n), 5)})
        want, met = plain_levels([H(str(i)) for i in range(n)], fanout), {}
        for a, b in pairwise(cuts):
            stack = M.MountainRange(n, fanout)
            for i in range(a, b):
                for level, pos, digest, edge in stack.push(i, H(str(i))):
                    met[level, pos] = digest
                assert all(len(run) < fanout for run in stack.open)
            met |= {(level, pos): digest for level, pos, digest, _ in stack.close()}
        assert all(want[level][pos] == digest for (level, pos), digest in met.items())


def test_positions_do_not_depend_on_the_ranges(scattered):
    rows = [("a" if i % 3 else "b", i % 50, i) for i in range(300)]
    df = scattered.createDataFrame(rows, "key string, o long, w long")
    got = positions(df, "key", [F.col("o"), F.col("w")], running=["w"]).collect()
    for key in "ab":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        there = sorted((r for r in got if r.key == key), key=lambda r: r.p_pos)
        assert [(r.o, r.w) for r in there] == [r[1:] for r in mine] and [r.p_pos for r in there] == list(range(len(mine)))
        assert [r.p_sum_w for r in there] == [sum(r[2] for r in mine[: i + 1]) for i in range(len(mine))]
        assert {(r.p_total, r.p_all_w) for r in there} == {(len(mine), sum(r[2] for r in mine))}
    assert len({r.p_part for r in got}) > 3
