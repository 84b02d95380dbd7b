"""Writing tables, and resuming: cached metrics, keys of configurations, work done and left."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> bool:
    """Whether a table was written to the end; works on any store of the session."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{marker}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def compute_or_load(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path if it is there, whole and readable, else computed, written and read back."""
    if not force and exists(spark, path):
        try:
            df = spark.read.parquet(path)
            df.limit(1).collect()
            return df
        except Exception as e:  # a corrupt table is computed again
            print(f"recomputing {path}: {type(e).__name__}")
    publish(compute(), path)
    return spark.read.parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there once it is whole: a reader finds the old table or the new one, and a
    run that fails leaves the old one. Works on any store of the session that can rename folders."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    at = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    store = at[path].getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
        if store.exists(at[path]):
            store.rename(at[path], at[old])
        if not store.rename(at[new], at[path]):
            raise OSError(f"could not move {new} to {path}")
    finally:
        if store.exists(at[old]) and not store.exists(at[path]):
            store.rename(at[old], at[path])
        for p in (new, old):
            store.delete(at[p], True)


def write_reports(reports: dict[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """One table per report: one file where it is the small summary that reports are, and as many as its size asks for where not."""
    for name, df in reports.items():
        df.hint("rebalance").write.mode("overwrite").option("header", "true").format(fmt).save(f"{root}/{name}")


def write_volume(df: DataFrame, path: str, channel: str = "channel") -> None:
    """Sparse voxel rows partitioned by channel."""
    df.write.mode("overwrite").partitionBy(channel).parquet(path)


def config_key(config: dict) -> str:
    """A canonical key: names sorted, numbers to six significant digits."""
    return "_".join(f"{k}{v:.6g}" if isinstance(v, float) else f"{k}{v}" for k, v in sorted(config.items()))


def key_column(config: str) -> Column:
    """The same for a map column of strings."""
    entries = F.transform(F.map_entries(config), lambda e: F.concat(e["key"], e["value"]))
    return F.array_join(F.array_sort(entries), "_")


def set_signature(values: list[str]) -> str:
    return hashlib.sha1("\n".join(sorted(values)).encode()).hexdigest()


def same_set(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    """Whether two tables hold the same set of keys."""
    x, y = (d.select(*keys).distinct() for d in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def fingerprint(edges: DataFrame, value: str = "d2") -> DataFrame:
    """One row that tells a graph: nodes, edges, mean and deviation of the edge values."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("n"))
    n = ends.agg(F.countDistinct("n").alias("n_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return n.crossJoin(F.broadcast(e))


def todo(units: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Units without a completed record."""
    return units.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: a maximum, combined before the shuffle."""
    rest = [c for c in records.columns if c not in keys and c not in order]
    last = records.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in records.columns])


def smallest_superset(inventory: DataFrame, column: str, least: int) -> DataFrame:
    """Of cached artefacts, the smallest that is large enough."""
    return inventory.where(F.col(column) >= least).orderBy(column).limit(1)


def inventory(files: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """Fields parsed from file names by patterns with one group; null where a name has none."""
    out = files
    for name, pattern in fields.items():
        found = F.regexp_extract(path, pattern, 1)
        out = out.withColumn(name, F.when(found != "", found))
    return out
