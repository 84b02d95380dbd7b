"""Queries of this package against their SQL on the smallest tables."""

import duckdb
import pytest

from lodestrata.llm import registry
from tests.test_queries import SF, TABLES, plain


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == want
