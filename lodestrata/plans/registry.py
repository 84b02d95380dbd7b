"""How queries are registered, and helpers for the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRIMARY = {"lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"}


class Catalog(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def put(f):
            assert name not in self, name
            self[name] = (f, sql)
            return f

        return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded, so that the order of a sum does not show."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places)


def R(expression: str, places: int = 6) -> str:
    """The same in SQL; adding 0 turns a negative zero into zero."""
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0)"


def i(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
