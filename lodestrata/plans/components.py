"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release


def _edges(df: DataFrame, distinct: bool = True) -> DataFrame:
    """Undirected edges, larger end first."""
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    found = df.select(big, small).where("a <> b")
    return found.distinct() if distinct else found


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node it reaches.

    Each round is two minimum-aggregations and two joins; all state is a table in the shared
    folder, so nothing but one fingerprint row of the table reaches the driver. The number of
    rounds grows with the logarithm of the longest path. Self-loops and nulls link nothing;
    an empty table has no rows out.
    """
    kept = cut(_edges(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")), "edges")
    before = _fingerprint(kept)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = kept.unionAll(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # repeats that this step makes do no harm before the next one drops them
        large = cut(_edges(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), distinct=False), "large")
        # small star: every edge hangs on its larger end; the end and its other neighbours go to the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(_edges(moved.unionAll(down.select("a", F.col("m").alias("b")))), "small")
        after = _fingerprint(new)
        release(large)
        release(kept)
        kept = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    mix = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(mix).alias("x"), F.sum(F.pmod(mix, F.lit(1_000_003))).alias("s")).first()
    return row["n"], row["x"], row["s"]
