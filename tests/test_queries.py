"""Every registered query against its SQL on the smallest tables, and the contract of the entry module."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from lodestrata import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_repeats(spark, name):
    rows = [sorted(map(str, catalog.queries()[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_the_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["A1_channel_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("l_shipdate" not in line and "p_name" not in line for line in read)
    plan = catalog.queries()["S1_S2_P1_dnf_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
