"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors of cosine c lie sqrt(2 - 2c) apart once normalised. A table hashes a vector by K
quantised Gaussian projections floor((a.v + b) / W), whose chance to agree falls with the
distance. K grows with the logarithm of the number of vectors, so that a vector meets about one
unrelated one in a table however many there are, and the number of tables is what keeps the chance that
all of them miss a pair at the threshold under MISSED; closer pairs are missed less.

Copies of a vector are one node with a count. Only hashes of nodes are dealt by bucket; of buckets with the same
nodes the first is kept, and vectors are fetched for what is left. Large buckets are cut into blocks and every
pair of blocks is a task of its own, so no bucket meets in one place; small buckets of one size are multiplied together. A pair is
counted in the first table where it meets. What a block gives back is a sum of links for each node and a
spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import cut
from .common import table
from .topk_search import usable

THRESHOLD = 0.98
W = 1.0
#: Chance that a pair at the threshold meets in no table.
MISSED = 1e-5
SEED = 11
#: Nodes in a block of a bucket, and in a bucket that is multiplied together with others of its size.
BLOCK, SMALL = 1024, 64
#: Products of small buckets worked out at a time.
CELLS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def agreement(distance: float) -> float:
    """Chance that one quantised projection of two vectors so far apart is the same."""
    below = 0.5 * math.erfc(W / distance / math.sqrt(2))
    return 1 - 2 * below - 2 * distance / (math.sqrt(2 * math.pi) * W) * (1 - math.exp(-((W / distance) ** 2) / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Projections of a table and the number of tables for n vectors."""
    near, far = agreement(math.sqrt(max(2 - 2 * threshold, 1e-6))), agreement(math.sqrt(2))
    # one projection more than brings unrelated neighbours down to one: keys are cheaper to deal than vectors
    k = max(4, 1 + round(math.log(max(n, 1)) / -math.log(far)))
    return k, math.ceil(math.log(MISSED) / math.log1p(-(near**k)))


def _normalised(rows: list) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_keys(vectors: list, labels: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(n, tables) keys of vectors of equal length; the label and the length are part of a key."""
    m = _normalised(vectors)
    rng = np.random.default_rng([SEED, m.shape[1]])
    a, b = rng.normal(size=(m.shape[1], tables * k)), rng.uniform(0, W, tables * k)
    keys = _mix(labels.astype(np.int64).view(np.uint64)[:, None] * _MIX + np.uint64(m.shape[1]) + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019))
    for at in range(0, len(m), 512):
        cells = np.floor((m[at : at + 512] @ a + b) / W).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        for i in range(k):
            keys[at : at + 512] = _mix(keys[at : at + 512] * _MIX + cells[:, :, i])
    return keys.view(np.int64)


def _keys(k: int, tables: int):
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, labels in batches:
            out: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors], dtype=np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                with np.errstate(over="ignore"):
                    found = bucket_keys([vectors.iloc[i] for i in at], labels.to_numpy()[at], k, tables)
                for i, row in zip(at, found, strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return of


def whole_runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of a partition that is sorted by keys, cut so that no group is in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        starts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        same = bool(held) and (held[-1][keys].to_numpy()[-1] == k[0]).all()
        if held and not same:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        if len(starts):
            held.append(frame.iloc[: starts[-1]])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(frame.iloc[starts[-1] if len(starts) else 0 :])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For symmetric boolean matrices (groups, n, n), the smallest of the names (groups, n) that each row reaches."""
    top = np.iinfo(np.int64).max
    root = names
    while True:
        new = np.minimum(root, np.where(linked, root[:, None, :], top).min(axis=2))
        if (new == root).all():
            return root
        root = new


def _links(at: np.ndarray, m: np.ndarray, f: dict, keys: np.ndarray, threshold: float) -> pd.DataFrame | None:
    """Links inside groups of one size: at (groups, n) has the rows of each, f the columns."""
    g = m[at]
    linked = np.matmul(g, g.transpose(0, 2, 1)) >= threshold
    linked[:, np.arange(at.shape[1]), np.arange(at.shape[1])] = False
    block, cross = f["blk"][at], (f["i"] != f["j"])[at[:, 0]]
    linked &= ~cross[:, None, None] | (block[:, :, None] != block[:, None, :])
    r, x, y = np.nonzero(linked)
    if not len(r):
        return None
    t = f["t"][at[:, 0]]
    before = np.arange(keys.shape[1])
    for k in range(0, len(r), 1 << 14):  # the first table where a pair meets is the one that counts it
        s = slice(k, k + (1 << 14))
        met = (keys[at[r[s], x[s]]] == keys[at[r[s], y[s]]]) & (before < t[r[s], None])
        linked[r[s], x[s], y[s]] = ~met.any(axis=1)
    counts = np.matmul(linked, f["mult"][at].astype(np.float64)[:, :, None])[:, :, 0]
    hit = counts > 0
    rows = at[hit]
    return pd.DataFrame({"h1": f["h1"][rows], "h2": f["h2"][rows], "links": counts[hit].astype(np.int64), "a": f["nid"][rows], "b": forest(linked, f["nid"][at])[hit]})


def _check(threshold: float):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, ["bkey", "i", "j"]):
            lengths = frame["v"].map(len).to_numpy()
            out = []
            for length in np.unique(lengths):
                g = frame[lengths == length]
                m, keys = _normalised(g["v"].tolist()), np.array(g["keys"].tolist())
                f = {c: g[c].to_numpy() for c in ("bkey", "i", "j", "label", "blk", "t", "h1", "h2", "nid", "mult")}
                # hashes of other labels, tables or lengths may be the same: a group is alike in all of them
                own = np.stack([f[c] for c in ("bkey", "i", "j", "label", "t")])
                starts = np.concatenate([[0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1])
                sizes = np.diff(np.append(starts, len(g)))
                for n in np.unique(sizes[sizes > 1]):
                    first = starts[sizes == n]
                    step = max(1, CELLS // int(n * max(n, m.shape[1]))) if n <= SMALL else 1
                    for k in range(0, len(first), step):
                        out.append(_links(first[k : k + step, None] + np.arange(n)[None], m, f, keys, threshold))
            out = [x for x in out if x is not None and len(x)]
            if out:
                yield pd.concat(out)

    return of


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link when their labels are equal and not null, their vectors have one length and their cosine in
    double precision is at least `threshold`. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without vec_id or label, link with nothing and are components of their own. Copies link with
    each other; rows that repeat a vec_id are one node of the components and count as rows in n_links.
    An empty table gives no rows; other columns are not read, whatever their names.
    """
    k, tables = shape(vectors.count(), threshold)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col(vector).alias("v"))
    joins_in = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0.0)
    rows = rows.withColumn("in", F.coalesce(joins_in, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("in"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("in"), F.xxhash64(F.lit(SEED), "v", "label")))
    nodes = rows.where("in").groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("nid"), F.count("*").alias("mult"))
    keys = F.pandas_udf(_keys(k, tables), "array<long>")
    nodes = cut(nodes.select("h1", "h2", "label", "nid", "mult", "v", keys("v", "label").alias("keys")), "nodes")
    # dealt out once: what buckets hold and who is in them read all columns, so they share one shuffle
    spread = nodes.select("h1", F.posexplode("keys").alias("t", "bkey")).repartition("bkey")
    held = spread.groupBy("bkey").agg(
        F.count("*").alias("n"), F.min("t").alias("t"), F.bit_xor(F.xxhash64("h1", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("h1", F.lit(2))).alias("x2")
    )
    # of buckets with the same nodes the one of the first table is looked into
    kept = held.where("n > 1").groupBy("n", "x1", "x2").agg(F.min(F.struct("t", "bkey")).alias("first")).select("n", F.col("first.bkey").alias("bkey"))
    members = spread.join(kept, "bkey").withColumnRenamed("h1", "id")
    members = members.join(nodes, (F.col("id") == F.col("h1")) & (F.get("keys", F.col("t")) == F.col("bkey"))).drop("id")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("nb", n_blocks).withColumn("blk", F.pmod(F.col("h2"), F.col("nb")).cast("int"))
    members = members.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    members = members.withColumn("i", F.least("blk", "p")).withColumn("j", F.greatest("blk", "p"))
    columns = ["bkey", "i", "j", "label", "blk", "t", "h1", "h2", "nid", "mult", "v", "keys"]
    dealt = members.select(columns).repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j", "label", "t")
    found = cut(dealt.mapInPandas(_check(threshold), "h1 long, h2 long, links long, a long, b long"), "links")
    roots = components(found.select("a", "b"))
    per_node = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    facts = nodes.select("h1", "h2", "nid", "mult").join(per_node, ["h1", "h2"], "left").join(roots, F.col("nid") == F.col("node"), "left")
    facts = facts.select("h1", "h2", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "nid").alias("own"))
    out = rows.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    out = out.select(
        "vec_id", F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("own", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_dedup": query}

ORACLE = {
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))
        / sqrt(list_sum(list_transform(a.e, lambda x: x * x))) / sqrt(list_sum(list_transform(b.e, lambda x: x * x))) >= 0.98),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN m ON e.vec_id = m.a
"""
}
