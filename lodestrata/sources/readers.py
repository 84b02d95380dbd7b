"""Reading tables: pushed-down disjunctive filters, whole-section scans, metric files, arrays and volumes."""

from __future__ import annotations

import ast
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import portable_hash

_OPS = {
    "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
}


def dnf(groups: list) -> Column:
    """A disjunction of conjunctions [[(column, op, value), ...], ...]; a flat list of clauses is a disjunction of single clauses."""
    if not groups:
        return F.lit(True)
    groups = [g if isinstance(g[0], (list, tuple)) else [g] for g in groups]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_OPS[op](F.col(c), v) for c, op, v in g]) for g in groups])


def and_in(groups: list, column: str, values: list) -> list:
    """The same disjunction with an IN clause in every conjunction."""
    groups = [g if isinstance(g[0], (list, tuple)) else [g] for g in groups]
    return [[*g, (column, "in", list(values))] for g in groups] or [[(column, "in", list(values))]]


def parse_dnf(text: str) -> list:
    """A filter written as a Python or JSON literal."""
    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)


def parse_tokens(text: str) -> list[tuple[int, int]]:
    """"4:100,8:50" as [(4, 100), (8, 50)]."""
    return [tuple(map(int, part.split(":"))) for part in text.split(",") if part]


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: list | Column | None = None) -> DataFrame:
    """Projected and filtered Parquet scan; both reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where if isinstance(where, Column) else dnf(where))
    return df.select(*columns) if columns else df


def load_split(path: str) -> dict[str, list]:
    """A split file {train, test, ignore} of clause lists, from any store the session's driver can open."""
    with open(path) as f:
        found = json.load(f)
    return {k: [tuple(c) for c in found.get(k, [])] for k in ("train", "test", "ignore")}


def split_column(split: dict[str, list], name: str = "split") -> Column:
    """train, test or null for each row; what is ignored is neither."""
    train, test = dnf(split["train"]), dnf(split["test"])
    keep = ~dnf(split["ignore"]) if split["ignore"] else F.lit(True)
    return F.when(keep & test, "test").when(keep & train, "train").alias(name)


def duplicate_folds(splits: dict[str, dict[str, list]]) -> list[tuple[str, str]]:
    """Pairs of folds with equal train and test sets."""
    seen: dict[str, str] = {}
    twice = []
    for name in sorted(splits):
        sign = json.dumps([sorted(map(list, splits[name][k]), key=str) for k in ("train", "test")])
        if sign in seen:
            twice.append((seen[sign], name))
        seen.setdefault(sign, name)
    return twice


def whole_sections(df: DataFrame, section: str, order: list[Column], cap: int) -> DataFrame:
    """All rows of the first sections, in the given order, until their running row count passes the cap (the first always stays).

    Counts are one aggregation; the rows come back by a semi-join on the sections chosen.
    """
    counts = df.groupBy(section).agg(F.count(F.lit(1)).alias("_n"))
    from ..operators.bins import global_rank

    ranked = global_rank(counts, [*order, F.col(section)], "_k", running={"_run": "_n"})
    chosen = ranked.where((F.col("_run") <= cap) | (F.col("_run") == F.col("_n"))).select(section)
    return df.join(chosen, section, "left_semi")


def excluding(df: DataFrame, column: str, values: list, cap: int, seed: int, *key: str) -> DataFrame:
    """Rows whose column is none of the values, at most `cap` of them, by hash."""
    return df.where(~F.col(column).isin(values)).orderBy(portable_hash(seed, *key), *key).limit(cap)


def schema_table(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def channel_columns(df: DataFrame, named: list[str], dtype: tuple[str, ...] = ("float", "double")) -> list[str]:
    """Of an explicit list, the channels that a table has with a floating type; never inferred from types alone."""
    types = dict(df.dtypes)
    return [c for c in named if types.get(c) in dtype]


def resolve_channels(available: list[str], wanted: list, strict: bool = False) -> list[str]:
    """Channels by index or name, in the order wanted, without repeats. Strict: exact, else the one channel that
    contains the name in any case, else an error; otherwise unknown ones are left out."""
    out: list[str] = []
    for w in wanted:
        found = None
        if isinstance(w, int):
            found = available[w] if 0 <= w < len(available) else None
        elif w in available:
            found = w
        elif strict:
            near = [a for a in available if str(w).lower() in a.lower()]
            found = near[0] if len(near) == 1 else None
        if found is None and strict:
            raise KeyError(w)
        if found is not None and found not in out:
            out.append(found)
    return out


def metric_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """CSV metric tables of many runs; malformed lines are dropped, and path tells the file."""
    df = spark.read.csv(glob, schema=schema, header=True, mode="DROPMALFORMED")
    return df.withColumn("path", F.input_file_name())


def discover_runs(spark: SparkSession, roots: list[str], pattern: str = "*.csv", schema: str = "value string") -> DataFrame:
    """(run, path) of the files below the roots; of a run found under several, the first root wins."""
    found = None
    for k, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
        part = files.select(F.lit(k).alias("root"), "path", F.element_at(F.split("path", "/"), -2).alias("run"))
        found = part if found is None else found.unionByName(part)
    first = F.row_number().over(Window.partitionBy("run").orderBy("root", "path"))
    return found.withColumn("_n", first).where("_n = 1").select("run", "path")


def arrays(spark: SparkSession, path: str, columns: list[str], step: int = 1 << 16) -> DataFrame:
    """Rows of 2-D .npy files as (row_id, columns...): files are read by the session and parsed on the executors."""
    import io

    import numpy as np
    import pandas as pd

    def rows(frames):
        for f in frames:
            for content in f["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                m = m.reshape(len(m), -1)
                for at in range(0, len(m), step):
                    part = pd.DataFrame(m[at : at + step].astype("float64"), columns=columns)
                    part.insert(0, "row_id", np.arange(at, at + len(part)))
                    yield part

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInPandas(rows, "row_id long, " + ", ".join(f"`{c}` double" for c in columns))


def array_slices(spark: SparkSession, path: str, columns: list[str], rows: int = 1 << 20) -> DataFrame:
    """(file, row_id, columns...) of the .npy files that a path or glob names, in any numeric type and either order: each file is planned as slices of at
    most so many rows, and a task maps its slice alone into memory. For folders that driver and executors see as a file system; arrays() reads
    from any store, a file a task. Arrays of more dimensions have their later ones flattened. A file whose width is not that of columns is an error.
    """
    from .array_source import ArraySlices

    spark.dataSource.register(ArraySlices)
    return spark.read.format("npy_slices").option("columns", "\n".join(columns)).option("rows", str(rows)).load(path)


def swiss_roll(spark: SparkSession, n: int, turns: float = 1.5, height: float = 10.0, seed: int = 0) -> DataFrame:
    """(id, t, x, y, z) on a rolled sheet, for tests."""
    u, v = (F.rand(seed + k) for k in (1, 2))
    t = 1.5 * 3.141592653589793 * (1 + 2 * u * turns / 1.5)
    return spark.range(n).select("id", t.alias("t"), (height * v).alias("y")).select("id", "t", (F.col("t") * F.cos("t")).alias("x"), "y", (F.col("t") * F.sin("t")).alias("z"))


def box_and_cylinder(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, label, x, y, z): points of a box (label 1) with a cylinder inside (label 2), for tests."""
    df = spark.range(n).select("id", *[(F.rand(seed + k) * 2 - 1).alias(c) for k, c in enumerate("xyz")])
    return df.withColumn("label", F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") < 0.25, 2).otherwise(1))


def coarsen(labels: DataFrame, tree: DataFrame, depth: int, label: str = "region") -> DataFrame:
    """Labels replaced by their ancestor at a depth; tree is (id, path array from the root); deeper only, unknown labels stay."""
    anc = tree.select(F.col("id").alias("_id"), F.when(F.size("path") > depth, F.element_at("path", depth + 1)).otherwise(F.col("id")).alias("_anc"))
    return labels.join(anc, labels[label] == anc["_id"], "left").withColumn(label, F.coalesce("_anc", label)).drop("_id", "_anc")
