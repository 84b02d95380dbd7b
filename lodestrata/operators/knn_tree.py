"""Exact nearest neighbours in few dimensions over a space-partition tree; nothing about the data's scale has to be known.

A bounded sample of the references is split at medians, widest side first; the splits cut space into leaves of about
equal counts wherever the data are dense or sparse. References are dealt to their leaf and, within a margin, to leaves nearby; queries are searched
in their own leaf. Most are settled there: their k-th distance lies within the margin. The others visit the leaves that their ball
still touches, nearest first and a few a round, so that a query from a sparse region at the edge of a dense one draws its ball in before it
visits more. Splits, boxes and counts of leaves are all that the driver holds (at most CELLS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: The tree has no more leaves than this; with more than CELLS * LEAF references, leaves grow instead.
CELLS, LEAF = 1 << 15, 4096
#: Leaves that an unsettled query visits in a round, and queries searched in one leaf by one task.
VISITS, CHUNK = 8, 1 << 15
#: Points in a bucket, the unit of work inside a leaf.
BUCKET = 64
#: Copies of one place crowd a leaf beyond so many times its size; then k + 1 references of each place are enough.
CROWDED = 8


def _median_groups(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Indices of points in groups of at most `size`, split at medians of the widest side."""
    todo, done = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        here = points[at]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        order = np.argpartition(here[:, axis], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


def _box_d2(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance between boxes (or points, where lo is hi)."""
    gap = np.maximum(np.maximum(low - hi, lo - high), 0.0)
    return (gap * gap).sum(axis=-1)


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        gap = a[:, axis, None] - b[None, :, axis]
        out += gap * gap
    return out


def _top(d2: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest values up to its limit, ties to smaller ids, in order."""
    bound = limit if d2.shape[1] <= k else np.minimum(np.partition(d2, k - 1, axis=1)[:, k - 1], limit)
    row, col = np.nonzero(d2 <= bound[:, None])
    order = np.lexsort((ids[col], d2[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def local_knn(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, same: bool, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, d2) of the k nearest points within each query's limit, by query and then rank.

    Queries and points are grouped into buckets. The nearest buckets of a group give a bound; all buckets within it are searched at once.
    """
    if not len(points) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit = np.full(len(queries), np.inf) if limit is None else limit
    buckets = _median_groups(points, BUCKET)
    lo, hi = (np.array([f(points[b], axis=0) for b in buckets]) for f in (np.min, np.max))
    size, want, out = np.array([len(b) for b in buckets]), k + 1 if same else k, []
    for group in _median_groups(queries, BUCKET):
        q, near = queries[group], limit[group]
        gaps = _box_d2(q.min(axis=0), q.max(axis=0), lo, hi)
        order = np.argsort(gaps, kind="stable")
        enough = int(np.searchsorted(np.cumsum(size[order]), max(want, BUCKET))) + 1
        first = np.concatenate([buckets[b] for b in order[:enough]])
        if len(first) >= want:
            near = np.minimum(near, np.partition(_d2(q, points[first]), want - 1, axis=1)[:, want - 1])
        at = np.concatenate([buckets[b] for b in np.flatnonzero(gaps <= near.max())] or [first[:0]])
        if not len(at):
            continue
        d2 = _d2(q, points[at])
        if same:
            d2[query_ids[group][:, None] == ids[at][None, :]] = np.inf
            near = np.where(np.isinf(near), np.finfo(float).max, near)
        row, col = _top(d2, ids[at], k, near)
        out.append((group[row], ids[at][col], d2[row, col]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, dst, d2 = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], dst[order], d2[order]


class Tree:
    """Median splits of a sample; later also the box, count and margin of every leaf. Small and sent to every task."""

    def __init__(self, sample: np.ndarray, leaves: int, least: int):
        self.axis, self.value, self.child = [-1], [0.0], [(-1, -1)]
        depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
        todo = [(0, sample, depth)]
        while todo:
            node, here, left = todo.pop()
            if left == 0 or len(here) < 2 * least:
                continue
            axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
            x = np.sort(here[:, axis])
            value = x[len(x) // 2]
            if value == x[0]:
                value = x[np.searchsorted(x, value, side="right")] if x[-1] > value else value
            below = here[:, axis] < value
            if below.sum() < least or (~below).sum() < least:
                continue
            self.axis[node], self.value[node], self.child[node] = axis, float(value), (len(self.axis), len(self.axis) + 1)
            for _ in range(2):
                self.axis.append(-1), self.value.append(0.0), self.child.append((-1, -1))
            todo += [(self.child[node][0], here[below], left - 1), (self.child[node][1], here[~below], left - 1)]
        self.axis, self.value, self.child = np.array(self.axis), np.array(self.value), np.array(self.child)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point lies in."""
        node = np.zeros(len(points), dtype=np.int64)
        going = self.axis[node] >= 0
        while going.any():
            at = node[going]
            right = points[going, self.axis[at]] >= self.value[at]
            node[going] = self.child[at, right.astype(int)]
            going = self.axis[node] >= 0
        return node

    def measure(self, rows: list[tuple], dims: int, k: int) -> None:
        """Boxes of leaves (leaf, n, lows, highs) and of the nodes above them, and margins within which most queries will be settled."""
        shape = (len(self.axis), dims)
        self.lo, self.hi, self.n = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(len(self.axis))
        for leaf, n, lows, highs in rows:
            self.lo[leaf], self.hi[leaf], self.n[leaf] = lows, highs, n
        for node in range(len(self.axis) - 1, -1, -1):
            if self.axis[node] >= 0:
                a, b = self.child[node]
                self.lo[node], self.hi[node] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])
        leaf = np.flatnonzero((self.axis < 0) & (self.n > 0))
        side = np.maximum(self.hi[leaf] - self.lo[leaf], 0.0)
        # a cube that holds 2 k points at the leaf's density reaches beyond the k-th neighbour of most of its points
        margin = 0.5 * (2.0 * k / self.n[leaf] * np.prod(np.maximum(side, side.max(axis=1, keepdims=True) * 1e-3), axis=1)) ** (1.0 / dims) if len(leaf) else np.zeros(0)
        for _ in range(8):  # where the surroundings are denser than the leaf, a margin must not draw them all in
            heavy = self._inflow(leaf, margin) > 3.0 * self.n[leaf]
            if not heavy.any():
                break
            margin = np.where(heavy, margin / 2, margin)
        margin = np.where(self._inflow(leaf, margin) > 3.0 * self.n[leaf], 0.0, margin)
        self.wide_lo, self.wide_hi = self.lo.copy(), self.hi.copy()
        self.wide_lo[leaf] -= margin[:, None]
        self.wide_hi[leaf] += margin[:, None]
        for node in range(len(self.axis) - 1, -1, -1):
            if self.axis[node] >= 0:
                a, b = self.child[node]
                self.wide_lo[node], self.wide_hi[node] = np.minimum(self.wide_lo[a], self.wide_lo[b]), np.maximum(self.wide_hi[a], self.wide_hi[b])

    def _inflow(self, leaf: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """References that the leaves' widened boxes would hold, taking each leaf's own as evenly spread."""
        lo, hi = self.lo[leaf] - margin[:, None], self.hi[leaf] + margin[:, None]
        row, node = self._meet(lo, hi, np.zeros(len(leaf)), self.lo, self.hi)
        side = self.hi[node] - self.lo[node]
        shared = np.maximum(np.minimum(hi[row], self.hi[node]) - np.maximum(lo[row], self.lo[node]), 0.0)
        part = np.where(side > 0, shared / np.where(side > 0, side, 1.0), 1.0).prod(axis=1)
        return np.bincount(row, weights=part * self.n[node], minlength=len(leaf))

    def _meet(self, lo, hi, r2, low, high) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of boxes within a squared distance of leaves."""
        row, node, out = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64), []
        while len(row):
            near = _box_d2(lo[row], hi[row], low[node], high[node]) <= r2[row]
            row, node = row[near], node[near]
            leaf = self.axis[node] < 0
            out.append((row[leaf], node[leaf]))
            row, node = np.repeat(row[~leaf], 2), self.child[node[~leaf]].ravel()
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (row, node)

    def copies(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose widened box holds the point; its own one is among them."""
        return self._meet(points, points, np.zeros(len(points)), self.wide_lo, self.wide_hi)

    def touched(self, points: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, d2) of leaves whose references may lie within each point's ball."""
        row, leaf = self._meet(points, points, r2, self.lo, self.hi)
        return row, leaf, _box_d2(points[row], points[row], self.lo[leaf], self.hi[leaf])

    def inside(self, points: np.ndarray, r2: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Whether a ball lies within the widened box of a leaf."""
        r = np.sqrt(r2)[:, None] * (1 + 1e-12)
        return ((points - r >= self.wide_lo[leaf]) & (points + r <= self.wide_hi[leaf])).all(axis=1)


def _matrix(batch, dims: int) -> np.ndarray:
    return np.column_stack([batch.column(f"c{a}").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(f"c{a}").to_numpy() for a in range(dims)]) if batch.num_rows else np.zeros((0, dims))


def _columns(ids: np.ndarray, points: np.ndarray, **more) -> dict:
    return {"id": ids, **{f"c{a}": points[:, a] for a in range(points.shape[1])}, **more}


def _mapped(df: DataFrame, dims: int, of, more: str) -> DataFrame:
    """df's rows (id, c0, ...) through a function of arrays to (id, c0, ..., more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(of(batch, batch.column("id").to_numpy(), _matrix(batch, dims)))

    return df.mapInArrow(run, f"id long, {', '.join(f'c{a} double' for a in range(dims))}, {more}")


def _searched(queries: DataFrame, refs: DataFrame, dims: int, k: int, same: bool, tree, home: bool) -> DataFrame:
    """(src, dst, d2, open, c0, ...) for queries (id, c0, ..., leaf, r2) against the references dealt to their leaf. In a query's own leaf the row of
    its k-th neighbour tells whether it is still open, and only there are its coordinates kept."""
    per = F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")
    counts = cut(queries.groupBy("leaf").agg(per), "chunks")  # at most a row a leaf
    q = queries.join(F.broadcast(counts), "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    p = refs.join(F.broadcast(counts), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids = _matrix(left, dims), left.column("id").to_numpy()
        limit = left.column("r2").to_numpy()
        row, dst, d2 = local_knn(at, ids, _matrix(right, dims), right.column("id").to_numpy(), k, same, limit)
        still = np.zeros(len(row), dtype=bool)
        if home and len(row):
            splits = tree.value
            last = np.flatnonzero((np.arange(len(row)) - np.searchsorted(row, row)) == k - 1)
            leaf = left.column("leaf").to_numpy()[row[last]]
            unsure = last[~splits.inside(at[row[last]], d2[last], leaf)]
            r, other, _ = splits.touched(at[row[unsure]], d2[unsure])
            beyond = other != left.column("leaf").to_numpy()[row[unsure]][r]
            still[unsure[np.unique(r[beyond])]] = True
        kept = {f"c{a}": pa.array(at[row, a], mask=~still) for a in range(dims)}
        return pa.table({"src": ids[row], "dst": dst, "d2": d2, "open": still, **kept})

    shape = f"src long, dst long, d2 double, open boolean, {', '.join(f'c{a} double' for a in range(dims))}"
    return q.groupBy("leaf", "chunk").cogroup(p.groupBy("leaf", "chunk")).applyInArrow(of, shape)


def tree_blocks(points: DataFrame, key: str, coords: list[str], many: int) -> DataFrame:
    """(node, block from 0): points dealt into about so many blocks of near ones and about equal counts, by the splits of a bounded sample."""
    spark, dims, least = points.sparkSession, len(coords), 16
    narrow = points.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"c{a}") for a, c in enumerate(coords)]).na.drop()
    fraction = min(1.0, 8.0 * many * least / max(narrow.count(), 1))
    sample = np.array([tuple(row) for row in narrow.sample(fraction, seed=7).drop("id").collect()], dtype=float).reshape(-1, dims)
    tree = Tree(sample, min(many, CELLS), least)
    shipped = spark.sparkContext.broadcast((tree, np.cumsum(tree.axis < 0) - 1))
    made = _mapped(narrow, dims, lambda b, ids, at: _columns(ids, at, leaf=shipped.value[1][shipped.value[0].home(at)]), "leaf long")
    return made.select(F.col("id").alias("node"), F.col("leaf").cast("int").alias("block"))


def tree_knn(points: DataFrame, refs: DataFrame, key: str, coords: list[str], k: int, same: bool = False) -> DataFrame:
    """(src, dst, d2, rank) of the k nearest references of each point, exact, ties to smaller keys; with same, a key is no neighbour of itself.

    Rows with a null or NaN coordinate take no part. Where there are fewer than k references, all are returned. Copies of one
    place, however many, are found by their smallest keys. Empty tables give no rows. key is an integer column without repeats.
    """
    spark, dims = points.sparkSession, len(coords)
    names = [f"c{a}" for a in range(dims)]

    def narrow(df: DataFrame) -> DataFrame:
        out = df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names, strict=True)])
        return out.where(" and ".join(["id is not null", *[f"{n} is not null and not isnan({n}) and abs({n}) < 1e150" for n in names]]))

    r = cut(narrow(refs), "refs")
    n = r.count()
    least = max(16, k + 1)
    leaves = min(CELLS, max(1, n // LEAF))
    fraction = min(1.0, 2.0 * leaves * least / max(n, 1))
    sample = np.array([tuple(row) for row in r.sample(fraction, seed=7).select(*names).collect()], dtype=float).reshape(-1, dims)  # at most about 2 * CELLS * least
    grown = Tree(sample, leaves, least)
    shipped = spark.sparkContext.broadcast(grown)
    placed = cut(_mapped(r, dims, lambda b, ids, at: _columns(ids, at, leaf=shipped.value.home(at)), "leaf long"), "placed")
    stats = lambda df: df.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{w}{c}") for f, w in ((F.min, "l"), (F.max, "h")) for c in names]).collect()
    boxes = stats(placed)
    dealt = placed
    if max((b["n"] for b in boxes), default=0) > CROWDED * max(LEAF, n // leaves):
        place = F.row_number().over(Window.partitionBy("leaf", *names).orderBy("id"))
        dealt = cut(placed.withColumn("_p", place).where(F.col("_p") <= k + 1).drop("_p"), "thinned")
        boxes = stats(dealt)
    grown.measure([(b["leaf"], b["n"], [b[f"l{c}"] for c in names], [b[f"h{c}"] for c in names]) for b in boxes], dims, k)
    tree = spark.sparkContext.broadcast(grown)

    def spread(batch, ids, at):
        row, leaf = tree.value.copies(at)
        return _columns(ids[row], at[row], leaf=leaf)

    wide = _mapped(dealt, dims, spread, "leaf long")
    queries = placed if points is refs else _mapped(narrow(points), dims, lambda b, ids, at: _columns(ids, at, leaf=tree.value.home(at)), "leaf long")
    near = cut(_searched(queries.withColumn("r2", F.lit(float("inf"))), wide, dims, k, same, tree, home=True), "near")
    rank, dense = (f.over(Window.partitionBy("src").orderBy("d2", "dst")) for f in (F.row_number(), F.dense_rank()))
    going = near.where("open").select(F.col("src").alias("id"), *names, F.col("d2").alias("r2"), F.lit(-1.0).alias("past_d2"), F.lit(-1).cast("long").alias("past"))
    openers = near.where("open").select("src")
    found, done = near.join(openers, "src", "left_semi").select("src", "dst", "d2"), [near.join(openers, "src", "left_anti").select("src", "dst", "d2").withColumn("rank", rank)]
    while not going.isEmpty():

        def visit(batch, ids, at):
            splits = tree.value
            own, r2 = splits.home(at), batch.column("r2").to_numpy()
            row, leaf, d2 = splits.touched(at, r2)
            past, before = batch.column("past").to_numpy()[row], batch.column("past_d2").to_numpy()[row]
            new = (leaf != own[row]) & ((d2 > before) | ((d2 == before) & (leaf > past)))
            row, leaf, d2 = row[new], leaf[new], d2[new]
            order = np.lexsort((leaf, d2, row))
            row, leaf, d2 = row[order], leaf[order], d2[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            many = np.bincount(row, minlength=len(ids))[row] > VISITS
            kept = place < VISITS
            last = many & (place == VISITS - 1)
            return _columns(ids[row[kept]], at[row[kept]], r2=r2[row[kept]], leaf=leaf[kept], past_d2=d2[kept], more=last[kept])

        visits = cut(_mapped(going, dims, visit, "r2 double, leaf long, past_d2 double, more boolean"), "visits")
        new = _searched(visits, dealt, dims, k, same, tree, home=False).select("src", "dst", "d2")
        # what came within the margin is met again in its own leaf: repeats have one rank and are joined where they lie
        merged = found.unionByName(new).withColumn("rank", dense).where(F.col("rank") <= k)
        merged = cut(merged.groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.min("rank").alias("rank")), "merged")
        again = cut(visits.where("more").select("id", *names, "past_d2", F.col("leaf").alias("past")), "again")
        bound = merged.where(F.col("rank") == k).select(F.col("src").alias("id"), F.col("d2").alias("r2"))
        going = cut(again.join(bound, "id").select("id", *names, "r2", "past_d2", "past"), "going")
        ids = again.select(F.col("id").alias("src"))
        done.append(merged.join(ids, "src", "left_anti"))
        found = merged.join(ids, "src", "left_semi").select("src", "dst", "d2")
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out
