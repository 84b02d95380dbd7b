"""The edit join and line dedup against plain versions of the same thing."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s = rng.choice([s[:k] + rng.choice("abé ") + s[k:], s[:k] + s[k + 1 :], s[:k] + rng.choice("abé ") + s[k + 1 :]])
    return s


def test_banded_distance_and_within(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a", "b"), ("abcd", "abcd"), ("kitten", "sitting")]
    for _ in range(600):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 40)))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        rows = df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), most).alias("d"), line_dedup.within(F.col("a"), F.col("b"), most).alias("w")).collect()
        for r in rows:
            want = distance(r.a, r.b)
            assert r.d == want if want <= most else r.d > most, (r, want)
            assert r.w == (want <= most), (r, want)


def lines_for(rng):
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(18, 60))).strip() + "x" * 3 for _ in range(60)]
    base += ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 16))) for _ in range(120)]
    return [x for x in base + [edited(rng, s, n) for s in base for n in (1, 2, 2, 3)] if x]


def near(a, b):
    """Similarity 0.8 at least, and two edits at most."""
    return abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, max(len(a), len(b)) // 5)


@pytest.mark.parametrize("block", [1024, 5])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(2)
    lines = sorted(set(lines_for(rng)))
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("lid", F.xxhash64("line")).withColumn("n", F.length("line"))
    lid = {r.lid: r.line for r in df.collect()}
    pairs = [frozenset((lid[r.a], lid[r.b])) for r in line_dedup.near_links(df).collect()]
    want = {frozenset(p) for p in combinations(lines, 2) if near(*p)}
    assert set(pairs) == want and len(pairs) == len(want) and sum(max(map(len, p)) < 10 for p in want) > 20 and len(want) > 300


def plain(docs):
    """doc_id -> text after dedup, for docs with distinct ids."""
    owner, order = {}, lambda x: (owner[x], hashlib.md5(x.encode()).digest())
    for d, t in docs:
        for x in (t or "").split("\n"):
            if x:
                owner[x] = min(owner.get(x, d), d)
    dropped = set()
    for a, b in combinations(owner, 2):
        if near(a, b):
            dropped.add(max(a, b, key=order))
    out = {}
    for d, t in docs:
        seen, kept = set(), []
        for x in (t or "").split("\n"):
            if not x or (owner[x] == d and x not in seen and x not in dropped):
                kept.append(x)
            seen.add(x)
        out[d] = "\n".join(kept) if t is not None else None
    return out


def test_dedup_equals_plain(spark):
    rng = random.Random(3)
    pool = lines_for(rng)[:150] + ["Yes.", "No."]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() > 0.1 else "" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "z" * 1500 + "\nYes."), (104, "z" * 1500 + "y"), (105, "q" * 50000)]
    df = spark.createDataFrame([(d, t, "en", "clash", 3) for d, t in docs], "doc_id long, text string, lang string, lid string, pos int").repartition(4)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    want = plain(docs)
    assert {r.doc_id: r.text for r in got.collect()} == want
    report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    for d, t in docs:
        n = sum(x != "" for x in (t or "").split("\n"))
        left = sum(x != "" for x in (want[d] or "").split("\n"))
        assert report[d].n_lines == n and n - report[d].n_exact - report[d].n_near == left


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "one\ntwo"), (1, "one\ntwo"), (None, "two\nthree"), (None, "three\nfour"), (2, "four\nfour")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, "three"), (-1, "three"), (1, "one\ntwo"), (1, "one\ntwo"), (2, "four")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0 and line_dedup.line_report(df.limit(0)).count() == 0
