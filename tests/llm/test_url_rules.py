"""Url filters with many rules and with filters too large for the plan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import url_filter


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = sorted((-len(h + p), h + p, v != "block", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
    return (fits[0][1], fits[0][3]) if fits else (None, "allow")


def many(n, lengths, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    rules = [(rng.choice(["block", "allow"]), ".".join([*[word(2) for _ in range(rng.randrange(3))], "com"]), "/" + word(rng.randrange(lengths))) for _ in range(n)]
    urls = [f"https://{word(2)}.{word(2)}.com/{word(lengths)}" for _ in range(4 * n)] + [None, "", "x", "http://", "http://COM/" + word(lengths)]
    return rules, urls


@pytest.mark.parametrize("bits", [1 << 22, 64])
def test_many_rules_and_filters_outside_the_plan(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "PLAN_BITS", bits)
    rules, urls = many(150, 6, bits)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert any(r for r, _ in got.values()) and len({v for _, v in got.values()}) == 2


def test_thousands_of_rules_of_many_lengths(spark):
    rules, urls = many(1500, 20, 5)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    took = time.perf_counter() - began
    sample = random.Random(1).sample(range(len(urls)), 150)
    assert all(got[i] == plain(urls[i], rules) for i in sample) and took < 60  # a plan that grows with the rules took minutes
    assert url_filter.judge(pages.limit(3), ()).where(F.col("rule").isNull()).count() == 3
