"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks.

Vectors become integers floor(256 * x). Queries and candidates are packed into blocks of
bounded size, and blocks of candidates are dealt into lanes of a bounded size. A task holds the
candidates of a lane and every block of queries streams past them, so candidates travel once and
queries once a lane. Candidates lie in
vertical layout (a row for each dimension). For each query the dimensions come in order of the
query's mass; partial scores are accumulated block by block of dimensions, the remaining
dimensions are bounded by the product of the remaining masses (Cauchy-Schwarz), and candidates
that cannot reach the k-th best score any more are dropped and the rest compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K = 5
SCALE = 256
#: Vectors in a block of queries and in a block of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Bytes of candidates in a lane, about.
HELD_BYTES = 32 << 20
#: Dimensions that are accumulated at a time.
DIMS = 16

_LONG = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    """Not null, not empty, no component null, NaN or infinite."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine, F.lit(False))


def quantise(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as exact float64 integers, or as Python integers where float64 cannot add them exactly."""
    scaled = np.floor(matrix.astype(np.float64) * SCALE)
    top = np.abs(scaled).max(initial=0.0)
    if top * top * max(1, matrix.shape[1]) < 2.0**53:
        return scaled
    return np.frompyfunc(int, 1, 1)(scaled)


class Candidates:
    """A block of candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(quantise(matrix).T)

    def best(self, query_id: int, query: np.ndarray, k: int, floor_score=None) -> list[tuple[int, int]]:
        """The k best (score, id) for one query, ties to smaller ids, itself left out. Scores under floor_score may be dropped."""
        exact = self.columns.dtype == object or query.dtype == object
        order = np.argsort(-np.abs(query).astype(np.float64), kind="stable")
        q = query[order]
        alive = np.flatnonzero(self.ids != query_id)
        partial = np.zeros(len(alive), dtype=object if exact else np.float64)
        if exact:
            partial = partial + sum(self.columns[d][alive] * q[i] for i, d in enumerate(order))
        else:
            rest_q = np.sqrt(np.append(np.cumsum((q * q)[::-1])[::-1], 0.0))
            mass = self.mass[alive]
            for at in range(0, len(q), DIMS):
                dims = order[at : at + DIMS]
                block = self.columns[dims] if len(alive) == len(self.ids) else self.columns[np.ix_(dims, alive)]
                block = block[:, alive] if block.shape[1] != len(alive) else block
                partial = partial + q[at : at + DIMS] @ block
                mass = np.maximum(mass - np.einsum("ij,ij->j", block, block), 0.0)
                if len(alive) > k and at + DIMS < len(q):
                    slack = rest_q[at + DIMS] * np.sqrt(mass)
                    least = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                    if floor_score is not None:
                        least = max(least, floor_score)
                    keep = partial + slack >= least - 1e-6 * (1.0 + abs(least))
                    if not keep.all():
                        alive, partial, mass = alive[keep], partial[keep], mass[keep]
        scores = partial if exact else np.rint(partial).astype(np.int64)
        return sorted(zip((-s for s in scores.tolist()), self.ids[alive].tolist(), strict=True))[:k] if len(alive) <= 4 * k else self._select(scores, alive, k)

    def _select(self, scores: np.ndarray, alive: np.ndarray, k: int) -> list[tuple[int, int]]:
        if scores.dtype == object:
            near = np.arange(len(scores))
        else:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return sorted(zip((-s for s in scores[near].tolist()), self.ids[alive[near]].tolist(), strict=True))[:k]

    @property
    def mass(self) -> np.ndarray:
        if not hasattr(self, "_mass"):
            self._mass = np.einsum("ij,ij->j", self.columns, self.columns)
        return self._mass


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype=np.int64)
    return ids, np.frombuffer(row.data, dtype=np.float64).reshape(len(ids), -1)


def _pack(size: int):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors of a partition in blocks of equal dimension; what is left at the end makes short blocks."""
        held: dict[int, list] = {}

        def flush(dim: int) -> tuple:
            rows = held.pop(dim)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            return dim, ids.tobytes(), np.array([r[1] for r in rows], dtype=np.float64).tobytes()

        for frame in frames:
            out = []
            for vec_id, vector in zip(frame["vec_id"], frame["v"], strict=True):
                held.setdefault(len(vector), []).append((vec_id, vector))
                if len(held[len(vector)]) == size:
                    out.append(flush(len(vector)))
            yield pd.DataFrame(out, columns=["dim", "ids", "data"])
        yield pd.DataFrame([flush(d) for d in list(held)], columns=["dim", "ids", "data"])

    return of


def _search(k: int):
    """Rows sorted by lane, dimension and role (candidates first) -> each query's k best of the lane."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held = None, []
        for frame in frames:
            out = []
            for row in frame.itertuples():
                if (row.lane, row.dim) != place:
                    place, held = (row.lane, row.dim), []
                ids, data = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.data, dtype=np.float64)
                matrix = data.reshape(len(ids), -1)
                if not row.asks:
                    held.append(Candidates(ids, matrix))
                    continue
                for query_id, query in zip(ids.tolist(), quantise(matrix), strict=True):
                    known: list[tuple[int, int]] = []
                    for block in held:  # the best so far bound what the next blocks have to show
                        known = sorted(known + block.best(query_id, query, k, -known[-1][0] if len(known) == k else None))[:k]
                    out += [(query_id, vec_id, min(max(-neg, _LONG.min), _LONG.max)) for neg, vec_id in known]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return of


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product for every query row.

    Candidates are all rows but those with the query's own vec_id; ties go to the smaller vec_id, and
    repeated rows are candidates each. Vectors that are null, empty, or hold a null or non-finite
    component take no part, nor do rows without vec_id; vectors of different length do not meet. Scores
    beyond a 64-bit integer are given as its limit. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    shape = "dim int, ids binary, data binary"
    queries = rows.where("q").select("vec_id", "v").coalesce(max(1, spark.sparkContext.defaultParallelism // 4))
    size = 8 * (rows.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0)
    # a stated query set against all rows in blocks
    lanes = max(8, spark.sparkContext.defaultParallelism * 2, -(-size // HELD_BYTES))
    c_blocks = rows.select("vec_id", "v").mapInPandas(_pack(CANDIDATE_BLOCK), shape).withColumns({"asks": F.lit(False), "lane": F.pmod(F.xxhash64("ids"), F.lit(lanes))})
    q_blocks = queries.mapInPandas(_pack(QUERY_BLOCK), shape).withColumns({"asks": F.lit(True), "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>"))})
    dealt = c_blocks.unionByName(q_blocks).repartition(lanes, "lane").sortWithinPartitions("lane", "dim", "asks")
    found = dealt.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    return best_per_query(found, k)


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """Ranks of the k best rows per query, thinned in parts first so that no query's rows all meet at once."""
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("neg"), F.col("vec_id"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    thin = found.groupBy("query_id", part.alias("part")).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))
    merged = thin.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op5_topk_search": query}

ORACLE = {
    "op5_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
