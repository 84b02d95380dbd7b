"""What several operators of this package share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: ASCII white space as the contracts of this package define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their names, whatever characters are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def file_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A parameter file that is shipped to the executors whole, so its size is checked."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    with open(path, "rb") as f:
        return f.read()


def positions(df: DataFrame, key: str, order: list[Column], running: list[str] = (), name: str = "ranges") -> DataFrame:
    """df with p_part, p_pos, p_total, p_sum_* and p_all_*: the range of (key, order) that a row was dealt to, its position from 0 among
    the rows of its key (never null), their number, and sums of columns up to the row and over the whole key.

    Ranges and not keys are what a task holds, so a key with a third of all rows lies in many tasks. Before a range come
    the counts of the earlier ranges of its key, one row for each. order has to be total but for rows that are
    equal in all that is used of them.
    """
    dealt = df.repartitionByRange(F.col(key), *order).withColumn("p_part", F.spark_partition_id())
    # written once: ranges come from a sample, so a second evaluation could draw other ones
    ranged = cut(dealt, name)
    sums = {"pos": F.lit(1), **{f"sum_{c}": F.col(c) for c in running}}
    held = ranged.groupBy("p_part", key).agg(*[F.sum(w).alias(f"h_{n}") for n, w in sums.items()])
    earlier = Window.partitionBy(key).orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        "p_part", F.col(key).alias("p_key"), *[F.coalesce(F.sum(f"h_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in sums],
        *[F.sum(f"h_{n}").over(Window.partitionBy(key)).alias(f"a_{n}") for n in sums],
    ).withColumnRenamed("p_part", "p_of")
    inside = Window.partitionBy("p_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"l_{n}": F.sum(w).over(inside) for n, w in sums.items()})
    met = local.join(before, (F.col("p_part") == F.col("p_of")) & (F.col(key) == F.col("p_key")))
    out = [*quoted(df.columns), F.col("p_part"), (F.col("l_pos") + F.col("b_pos") - 1).cast("long").alias("p_pos"), F.col("a_pos").cast("long").alias("p_total")]
    return met.select(*out, *[(F.col(f"l_sum_{c}") + F.col(f"b_sum_{c}")).alias(f"p_sum_{c}") for c in running], *[F.col(f"a_sum_{c}").alias(f"p_all_{c}") for c in running])


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB's SQL, which has no function for it: bit by bit with the reversed polynomial."""
    bits = "list_reduce(list_concat([xor(a, b)], range(8)::UBIGINT[]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::UBIGINT)), lambda a, b: {bits}), 4294967295::UBIGINT)"
