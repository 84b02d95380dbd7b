"""Algebra on edge tables (src, dst, d2): labels, weights, pruning, Laplacians and their uses."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import heat, portable_hash, ratio
from ..plans.components import components
from ..plans.shared import cut, release
from .spatial import edges_from, symmetric


def with_labels(edges: DataFrame, nodes: DataFrame, key: str, label: str) -> DataFrame:
    """edges with the labels of both ends as l_src and l_dst."""
    a = nodes.select(F.col(key).alias("src"), F.col(label).alias("l_src"))
    b = nodes.select(F.col(key).alias("dst"), F.col(label).alias("l_dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def crosses(a: str = "l_src", b: str = "l_dst") -> Column:
    """Whether an edge joins two regions; label 0 (none) always crosses."""
    return (F.col(a) != F.col(b)) | (F.col(a) == 0) | (F.col(b) == 0)


def inflate(edges: DataFrame, nodes: DataFrame, key: str, label: str, factor: float) -> DataFrame:
    """edges with d2 of crossing ones times a factor, and cross."""
    out = with_labels(edges, nodes, key, label).withColumn("cross", crosses())
    return out.withColumn("d2", F.when(F.col("cross"), F.col("d2") * factor).otherwise(F.col("d2"))).select("src", "dst", "d2", "cross")


def prune(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """edges (with cross) without a share of the crossing ones, drawn by hash; nodes that would lose every
    edge keep their shortest one (ties to smaller ends)."""
    doomed = F.col("cross") & (F.conv(F.substring(portable_hash(seed, "src", "dst"), 1, 8), 16, 10).cast("double") / 4294967296.0 < share)
    marked = cut(edges.withColumn("doomed", doomed), "marked")
    ends = symmetric(marked)
    alone = ends.groupBy("src").agg(F.min(F.col("doomed").cast("int")).alias("all"), F.min(F.struct("d2", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))).alias("e"))
    rescued = alone.where("all = 1").select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).distinct()
    kept = marked.where(~F.col("doomed"))
    back = marked.where("doomed").join(rescued, ["src", "dst"], "left_semi")
    return kept.unionByName(back).drop("doomed")


def degree(edges: DataFrame, weight: Column | None = None, loop: float = 0.0) -> DataFrame:
    """(node, degree): sums over both ends, plus a self-loop."""
    w = F.lit(1.0) if weight is None else weight
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), w.alias("_w")).groupBy("node").agg((F.sum("_w") + loop).alias("degree"))


def laplacian(edges: DataFrame, bandwidth: float, alpha: float = 1.0) -> dict[str, DataFrame]:
    """Of the heat-kernel graph with unit self-loops: `nodes` (node, q, degree) and `edges` (src, dst, w), where w is
    the affinity over the product of the first degrees to the power alpha, and degree the sum of w and the self-loop's.
    """
    w = heat("d2", bandwidth)
    first = degree(edges, w, loop=1.0).withColumn("q", F.pow("degree", F.lit(alpha))).select("node", "q")
    met = edges.withColumn("_w", w)
    met = met.join(first.select(F.col("node").alias("src"), F.col("q").alias("qa")), "src").join(first.select(F.col("node").alias("dst"), F.col("q").alias("qb")), "dst")
    weighted = met.select("src", "dst", (F.col("_w") / (F.col("qa") * F.col("qb"))).alias("w"))
    second = weighted.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("s"))
    nodes = first.join(second, "node").select("node", "q", (F.col("s") + 1 / (F.col("q") * F.col("q"))).alias("degree"))
    return {"nodes": nodes, "edges": weighted}


def laplacian_entries(parts: dict[str, DataFrame], bandwidth: float) -> DataFrame:
    """(i, j, v): the symmetric normalised Laplacian (I - D^-1/2 W D^-1/2) / bandwidth^2, diagonal once, off-diagonals once."""
    n, e = parts["nodes"], parts["edges"]
    b2 = bandwidth * bandwidth
    diagonal = n.select(F.col("node").alias("i"), F.col("node").alias("j"), ((1 - 1 / (F.col("q") * F.col("q") * F.col("degree"))) / b2).alias("v"))
    a = n.select(F.col("node").alias("src"), F.col("degree").alias("da"))
    b = n.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    off = e.join(a, "src").join(b, "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w") / F.sqrt(F.col("da") * F.col("db")) / b2).alias("v"))
    return diagonal.unionByName(off)


def matvec(entries: DataFrame, vector: DataFrame, node: str = "node", value: str = "x") -> DataFrame:
    """(node, y): a symmetric matrix given by its entries (each off-diagonal once) times a vector; one join, one aggregation."""
    both = entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    x = vector.select(F.col(node).alias("j"), F.col(value).alias("_x"))
    return both.join(x, "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("_x")).alias("y"))


def random_walk(parts: dict[str, DataFrame], vector: DataFrame, node: str = "node", value: str = "x") -> DataFrame:
    """(node, y): one step of the random walk, self-loops included; rows of its matrix sum to one."""
    n = parts["nodes"]
    x = vector.select(F.col(node).alias("node"), F.col(value).alias("_x"))
    both = symmetric(parts["edges"])
    pulled = both.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("_x")).alias("s"))
    out = n.join(x, "node").join(pulled, "node", "left")
    return out.select("node", ((F.coalesce("s", F.lit(0.0)) + F.col("_x") / (F.col("q") * F.col("q"))) / F.col("degree")).alias("y"))


def nystrom(neighbours: DataFrame, values: DataFrame, bandwidth: float, node: str = "node", value: str = "x") -> DataFrame:
    """(src, y): values at new points as the mean of their neighbours' weighted by heat affinity over neighbour degree, weights summing to one.

    values: (node, x, degree).
    """
    v = values.select(F.col(node).alias("dst"), F.col(value).alias("_x"), F.col("degree").alias("_d"))
    met = neighbours.join(v, "dst").withColumn("_w", heat("d2", bandwidth) / F.col("_d"))
    return met.groupBy("src").agg(ratio(F.sum(F.col("_w") * F.col("_x")), F.nullif(F.sum("_w"), F.lit(0.0))).alias("y"))


def majority_vote(edges: DataFrame, labels: DataFrame, rounds: int = 1) -> DataFrame:
    """(node, label) after rounds of voting among neighbours, each node with one vote for itself; ties go to the smaller label.

    Stops when no label changes.
    """
    both = cut(symmetric(edges.select("src", "dst")), "both")
    now = labels.select("node", "label")
    for _ in range(rounds):
        votes = both.join(now.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").unionByName(now)
        counts = votes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        new = cut(counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("node", F.col("b.label").alias("label")), "votes")
        changed = not new.exceptAll(now).isEmpty()
        now = new
        if not changed:
            break
    return now


def component_sizes(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """(root, n) of all components, isolated nodes included."""
    roots = components(edges, "src", "dst").withColumnRenamed("node", key)
    return nodes.select(key).join(roots, key, "left").groupBy(F.coalesce("root", key).alias("root")).agg(F.count(F.lit(1)).alias("n"))


def connectivity(nodes: DataFrame, edges: DataFrame, bandwidths: list[float], least: float, key: str = "node") -> DataFrame:
    """(bw, n_components, largest_share, isolated_share) for the edges whose affinity reaches `least`."""
    out = None
    for bw in bandwidths:
        sizes = component_sizes(nodes, edges.where(heat("d2", bw) >= least), key)
        row = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("_max"), F.count_if(F.col("n") == 1).alias("_one"), F.sum("n").alias("_all"))
        row = row.select(F.lit(bw).alias("bw"), "n_components", (F.col("_max") / F.col("_all")).alias("largest_share"), (F.col("_one") / F.col("_all")).alias("isolated_share"))
        out = row if out is None else out.unionByName(row)
    return out


def affinity_stats(edges: DataFrame, bandwidths: list[float]) -> DataFrame:
    """Percentiles, mean, saturated and dead shares and sum of affinities for each bandwidth; one pass over the edges."""
    grid = edges.withColumn("bw", F.explode(F.array(*map(F.lit, bandwidths))))
    w = heat("d2", F.col("bw"))
    qs = F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])
    return grid.groupBy("bw").agg(F.percentile(w, qs).alias("q"), F.avg(w).alias("mean"), F.avg((w > 0.9).cast("double")).alias("saturated"), F.avg((w < 0.01).cast("double")).alias("dead"), F.sum(w).alias("total"))


def geodesic(edges: DataFrame, sources: DataFrame, most: float, rounds: int | None = 64) -> DataFrame:
    """(source, node, d) of shortest paths (edge length sqrt d2) up to a distance: relaxation of what changed, round by round, for at
    most so many rounds, or until nothing changes where rounds is None."""
    both = cut(symmetric(edges.select("src", "dst", F.sqrt("d2").alias("len"))), "lengths")
    known = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d")), "known")
    front = known
    for _ in count() if rounds is None else range(rounds):
        step = front.join(both, front["node"] == both["src"]).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("len")).alias("d")).where(F.col("d") <= most)
        best = step.groupBy("source", "node").agg(F.min("d").alias("d"))
        old = known.select("source", "node", F.col("d").alias("old"))
        front = cut(best.join(old, ["source", "node"], "left").where(F.col("old").isNull() | (F.col("d") < F.col("old"))).select("source", "node", "d"), "front")
        if front.isEmpty():
            break
        known = cut(known.unionByName(front).groupBy("source", "node").agg(F.min("d").alias("d")), "known")
    return known


#: Nodes of a block of the graph that one task searches: no more than BLOCK on the whole, and not cut finer than LEAST for more tasks.
BLOCK, LEAST = 4096, 1024


def blocks_for(spark, n: int) -> int:
    """How many blocks n nodes are dealt into."""
    return max(1, -(-n // BLOCK), min(2 * spark.sparkContext.defaultParallelism, n // LEAST))


def geodesic_knn(edges: DataFrame, k: int, nodes: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(source, node, d, rank): the k nodes nearest to every node along the edges (length sqrt d2), ties to smaller nodes; with
    nodes (node, place), only those that stand before it in that order: the conditioning sets of a sequential factorisation.

    The graph lies in one block where it is small, or in blocks of near nodes (node, block from 0). Without those nearly every step would lead into
    another block, so a large graph is then searched hop by hop (_by_hops). Otherwise a task searches one block from all
    its nodes, or later from where paths came in, and sends paths that leave it on to other blocks. A path goes on only while it is no longer than its source's way to the
    k-th eligible node met, so a source sees about k n / place nodes; what a task has searched is not kept, only its nodes at the border and k nodes a source.
    Rounds grow with the blocks that a path crosses and end when none is shortened. Nodes that no path reaches are no neighbours.
    """
    both = cut(symmetric(edges.select("src", "dst", F.sqrt("d2").alias("len"))), "lengths")
    places = both.select(F.col("src").alias("node")).distinct()
    places = places.withColumn("place", F.lit(0.0)) if nodes is None else places.join(nodes.select("node", F.col("place").cast("double").alias("place")), "node", "left")
    many = blocks_for(edges.sparkSession, places.count()) if blocks is None else (blocks.agg(F.max("block")).first()[0] or 0) + 1
    if blocks is None and many > 1:
        return _by_hops(both, k, cut(places if nodes is None else nodes.select("node", "place"), "places"), nodes is not None)
    own = F.pmod(F.xxhash64(F.col("node").cast("long")), F.lit(many)).cast("int")
    places = cut(places.withColumn("block", own) if blocks is None else places.join(blocks, "node", "left").withColumn("block", F.coalesce("block", own)), "places")
    here, there = places.select(F.col("node").alias("src"), "block"), places.select(F.col("node").alias("dst"), F.col("block").alias("other"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    rows = both.join(here, "src").join(there, "dst").select("block", F.lit(1).alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("len").alias("d"), none.alias("place"), none.alias("most"), "other")
    graph = cut(rows.unionByName(places.select("block", F.lit(0).alias("kind"), F.col("node").cast("long").alias("a"), zero.alias("b"), none.alias("d"), "place", none.alias("most"), F.lit(0).alias("other"))), "graph")
    nearest = Window.partitionBy("source").orderBy("d", "node")
    best = sent = front = None
    while True:
        seen = graph if front is None else graph.unionByName(front.select(F.col("other").alias("block"), F.lit(2).alias("kind"), F.col("source").alias("a"), F.col("node").alias("b"), "d", "place", "most", F.lit(0).alias("other")))
        made = cut(seen.repartitionById(many, F.col("block")).mapInArrow(_searched(k, front is None, nodes is not None), "kind int, source long, node long, d double, place double, other int"), "round")
        found = made.where(f"kind = {FOUND}").select("source", "node", "d")
        old = best
        found = found if best is None else found.unionByName(best.select("source", "node", "d")).groupBy("source", "node").agg(F.min("d").alias("d"))
        # row_number up to k is cut before the shuffle, so a source that has met many nodes sends few
        best = cut(found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "best")
        moved = made.where(f"kind <> {FOUND}").groupBy("source", "node").agg(
            F.min(F.when(F.col("kind") == LEFT, F.col("d"))).alias("d"), F.min(F.when(F.col("kind") == EDGE, F.col("d"))).alias("known"), F.max("place").alias("place"), F.max("other").alias("other")
        )
        if sent is not None:
            moved = moved.join(sent.withColumnRenamed("d", "old"), ["source", "node"], "left").withColumn("known", F.least("known", "old")).drop("old")
        bound = best.where(F.col("rank") == k).select("source", F.col("d").alias("most"))
        fresh = moved.where("d is not null and (known is null or d < known)").drop("known").join(bound, "source", "left").where("most is null or d <= most")
        front = cut(fresh, "front")
        if front.isEmpty():
            return best
        arrived = front.select("source", "node", "d").unionByName(made.where(f"kind = {EDGE}").select("source", "node", "d"))
        before = sent
        sent = cut((arrived if sent is None else arrived.unionByName(sent)).groupBy("source", "node").agg(F.min("d").alias("d")), "sent")
        for done in (made, old, before):
            if done is not None:
                release(done)


def _by_hops(both: DataFrame, k: int, places: DataFrame, ordered: bool) -> DataFrame:
    """geodesic_knn() by a hop a round from all nodes at once, over edges in both directions (src, dst, len)."""
    here, there = places.select(F.col("node").alias("source"), F.col("place").alias("_a")), places.select("node", F.col("place").alias("_b"))
    fits = F.col("_b") < F.col("_a") if ordered else F.col("source") != F.col("node")
    front = places.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d"))
    known = None
    nearest = Window.partitionBy("source").orderBy("d", "node")
    while True:
        known = front if known is None else known.unionByName(front).groupBy("source", "node").agg(F.min("d").alias("d"))
        known = cut(known, "known")
        eligible = known.join(here, "source").join(there, "node").where(fits).select("source", "node", "d")
        # row_number up to k is cut before the shuffle, so a source that has met many nodes sends few
        best = cut(eligible.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "best")
        bound = best.where(F.col("rank") == k).select("source", F.col("d").alias("most"))
        step = front.join(both, front["node"] == both["src"]).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("len")).alias("d"))
        step = step.groupBy("source", "node").agg(F.min("d").alias("d")).join(bound, "source", "left").where(F.col("most").isNull() | (F.col("d") <= F.col("most")))
        old = known.select("source", "node", F.col("d").alias("old"))
        front = cut(step.join(old, ["source", "node"], "left").where(F.col("old").isNull() | (F.col("d") < F.col("old"))).select("source", "node", "d"), "front")
        if front.isEmpty():
            return best


#: What a search of a block gives: eligible nodes, paths into other blocks, and nodes at the border of the own one.
FOUND, LEFT, EDGE = 0, 1, 2


def _searched(k: int, first: bool, ordered: bool):
    """Searches of one block (rows of kind 0: a node with its place, 1: an edge, 2: a path that came in) from all its nodes, or from the paths that came in."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        kind, a, b, d, place, most, other = (whole[c].to_numpy() for c in ("kind", "a", "b", "d", "place", "most", "other"))
        nodes, edges, came = (np.flatnonzero(kind == v) for v in (0, 1, 2))
        if not first and not len(came):
            return
        nodes = nodes[np.argsort(a[nodes])]
        ids, stands = a[nodes], place[nodes].tolist()
        mine = np.isin(b[edges], ids)
        inner: list[list] = [[] for _ in ids]
        outer: list[list] = [[] for _ in ids]
        for u, v, length in zip(np.searchsorted(ids, a[edges[mine]]).tolist(), np.searchsorted(ids, b[edges[mine]]).tolist(), d[edges[mine]].tolist(), strict=True):
            inner[u].append((length, v))
        away = edges[~mine]
        goals = dict(zip(b[away].tolist(), other[away].tolist(), strict=True))
        for u, v, length in zip(np.searchsorted(ids, a[away]).tolist(), b[away].tolist(), d[away].tolist(), strict=True):
            outer[u].append((length, v))
        names = ids.tolist()

        def search(source: int, stand: float, limit: float, heap: list) -> list[tuple]:
            short, met, left, edge = {u: at for at, u in heap}, [], {}, []
            heapify(heap)
            while heap:
                at, u = heappop(heap)
                if at > limit:
                    break
                if at > short[u]:
                    continue
                if stands[u] < stand if ordered else names[u] != source:
                    met.append((at, names[u]))
                    if len(met) == k:
                        limit = min(limit, at)
                for length, v in inner[u]:
                    to = at + length
                    if to <= limit and to < short.get(v, inf):
                        short[v] = to
                        heappush(heap, (to, v))
                if outer[u]:
                    edge.append((EDGE, source, names[u], at, stand, 0))
                    for length, v in outer[u]:
                        to = at + length
                        if to <= limit and to < left.get(v, inf):
                            left[v] = to
            met.sort()
            return [(FOUND, source, v, at, stand, 0) for at, v in met[:k]] + [(LEFT, source, v, to, stand, goals[v]) for v, to in left.items() if to <= limit] + edge

        def starts() -> Iterator[tuple]:
            if first:
                yield from ((v, s, inf, [(0.0, u)]) for u, (v, s) in enumerate(zip(names, stands, strict=True)) if s == s)
                return
            at = came[np.argsort(a[came], kind="stable")]
            cuts = np.flatnonzero(np.diff(a[at])) + 1
            for group in np.split(at, cuts):
                bound = most[group[0]]
                yield int(a[group[0]]), float(place[group[0]]), inf if bound != bound else float(bound), list(zip(d[group].tolist(), np.searchsorted(ids, b[group]).tolist(), strict=True))

        out: list[tuple] = []
        for start in starts():
            out += search(*start)
            if len(out) >= 1 << 16:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, source, node, d, place, other = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "source": pa.array(source, pa.int64()), "node": pa.array(node, pa.int64()), "d": pa.array(d, pa.float64()), "place": pa.array(place, pa.float64()), "other": pa.array(other, pa.int32())})


def border_distance(nodes: DataFrame, border: DataFrame, key: str, label: str, coords: list[str], cell: float) -> DataFrame:
    """(key, other, d2): the nearest border node of another label, found in growing cells."""
    from .spatial import radius_join

    left, found = nodes.select(key, label, *coords).where(F.col(label).isNotNull()), None
    right = border.select(key, label, *coords)
    labels = right.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if labels["lo"] == labels["hi"]:  # nodes of the border's only label have none of another, however far one looks
        left = left.where(F.col(label) != F.lit(labels["lo"]))
    span = left.select(*coords).unionByName(right.select(*coords)).agg(*[F.max(F.abs(c)).alias(c) for c in coords]).first()
    most = 4 * sum(float(span[c] or 0) for c in coords) + cell
    while True:
        met = radius_join(left, right, coords, cell).where(F.col(f"l_{label}") != F.col(f"r_{label}"))
        best = met.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min(F.struct("d2", F.col(f"r_{key}").alias("k"), F.col(f"r_{label}").alias("o"))).alias("b"))
        best = cut(best.select(key, F.col("b.o").alias("other"), F.col("b.d2").alias("d2")), "border")
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best, key, "left_anti"), "left")
        if left.isEmpty() or cell > most:
            return found
        cell *= 2


def border_field(nodes: DataFrame, distances: DataFrame, key: str, label: str, scale: float, share: float = 0.95) -> DataFrame:
    """(key, label, other, d, z, rel) for border_distance()'s table: the distance in units of `scale`, its z-score over all nodes, and
    its part of the label's percentile, at most 1. A node without any other label has no distance. Only one row a label is joined back."""
    d = nodes.select(key, label).join(distances, key, "left").withColumn("d", F.sqrt("d2") * scale)
    d = cut(d.select(key, label, "other", "d"), "border-field")
    whole = d.agg(F.avg("d").alias("_mean"), F.stddev_pop("d").alias("_std"))
    parts = d.groupBy(F.col(label).alias("_l")).agg(F.percentile("d", F.lit(share)).alias("_p"))
    met = d.join(parts, F.col(label).eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(whole))
    return met.select(key, label, "other", "d", ((F.col("d") - F.col("_mean")) / (F.col("_std") + 1e-8)).alias("z"), F.least(F.greatest(F.col("d") / F.greatest("_p", F.lit(1e-8)), F.lit(0.0)), F.lit(1.0)).alias("rel"))


def border_summary(field: DataFrame, label: str, scale: float) -> DataFrame:
    """(mean, most, adjacent, labels): of a border_field(); adjacent is the share of nodes within one unit of `scale`."""
    return field.agg(F.avg("d").alias("mean"), F.max("d").alias("most"), F.avg((F.col("d") <= scale).cast("double")).alias("adjacent"), F.countDistinct(label).alias("labels"))


def build(neighbours: DataFrame, grid_edges: DataFrame | None = None) -> DataFrame:
    """The union of neighbour and grid edges, each once with its smallest d2."""
    e = edges_from(neighbours)
    return e if grid_edges is None else e.unionByName(grid_edges.select("src", "dst", "d2")).groupBy("src", "dst").agg(F.min("d2").alias("d2"))


def contiguous(nodes: DataFrame, edges: DataFrame, key: str, label: str, least: int) -> DataFrame:
    """(key, label, component, n, small): components of equal labels, and whether they are under a size."""
    same = with_labels(edges, nodes, key, label).where("l_src = l_dst")
    roots = components(same, "src", "dst").withColumnRenamed("node", key)
    out = nodes.select(key, label).join(roots, key, "left").withColumn("component", F.coalesce("root", key))
    out = cut(out.drop("root"), "parcels")
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"))  # counted and joined, so that the largest component is in no one task
    return out.join(sizes, "component").select(key, label, "component", "n", (F.col("n") < least).alias("small"))


def dissolve(nodes: DataFrame, edges: DataFrame, key: str, label: str, coords: list[str], least: int, share: float) -> DataFrame:
    """(key, label, new_label, component, dissolved): components of equal labels survive with at least `least` nodes and the given share of
    their label; where a label has none, its largest does (ties to the smaller root). Nodes of the others take the label of the nearest surviving node (ties to the
    smaller one). new_label counts the labels that are left from 0, in order.
    """
    from .knn_tree import tree_knn

    parts = cut(contiguous(nodes, edges, key, label, least).select(key, label, "component", "n"), "components")
    sizes = parts.groupBy(label, "component").agg(F.max("n").alias("n"))
    totals = sizes.groupBy(label).agg(F.sum("n").alias("_t"), F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("_m"))
    judged = sizes.join(totals, label).withColumn("_need", F.greatest(F.floor(F.lit(share) * F.col("_t")), F.lit(least)))
    alive = judged.where((F.col("n") >= F.col("_need")) | ((F.col("_m.n") < F.col("_need")) & (F.col("component") == -F.col("_m.c")))).select(F.col("component").alias("_alive"))
    marked = cut(parts.join(alive, F.col("component") == F.col("_alive"), "left").select(key, label, "component", F.col("_alive").isNull().alias("dissolved")), "marked")
    placed = nodes.select(key, *coords)
    lost = placed.join(marked.where("dissolved").select(key), key)
    kept = placed.join(marked.where(~F.col("dissolved")).select(key), key)
    near = tree_knn(lost, kept, key, coords, 1).select(F.col("src").alias(key), F.col("dst").alias("_dst"))
    given = near.join(marked.select(F.col(key).alias("_dst"), F.col(label).alias("_given")), "_dst").select(key, "_given")
    out = cut(marked.join(given, key, "left").withColumn("_label", F.coalesce("_given", label)), "filled")
    # as many rows as labels
    compact = out.select("_label").distinct().withColumn("new_label", (F.row_number().over(Window.orderBy("_label")) - 1).cast("long"))
    return out.join(compact, "_label").select(key, label, "new_label", "component", "dissolved")


def precision_matvec(entries: DataFrame, vector: DataFrame, scale: float, nu: int, node: str = "node", value: str = "x") -> DataFrame:
    """(node, y): (2 nu / scale^2 I + L)^nu times a vector, for a whole nu."""
    now = vector.select(F.col(node).alias("node"), F.col(value).alias("x"))
    for k in range(nu):
        y = matvec(entries, now)
        now = now.join(y, "node", "left").select("node", (2 * nu / (scale * scale) * F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
        if k < nu - 1:
            now = cut(now, "precision")
    return now.withColumnRenamed("x", "y")


def solve(entries: DataFrame, rhs: DataFrame, shift: float, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(node, x): (L + shift I) x = rhs by conjugate gradients; rhs is (node, b). A round is a mat-vec and two sums."""
    state = cut(rhs.select("node", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")), "cg")
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    first = rr
    for _ in range(rounds):
        if rr <= tolerance * tolerance * max(first, 1e-300):
            break
        q = matvec(entries, state, value="p")
        s = cut(state.join(q, "node", "left").withColumn("q", F.coalesce("y", F.lit(0.0)) + shift * F.col("p")).drop("y"), "cg")
        alpha = rr / s.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        s = s.select("node", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new = s.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = cut(s.select("node", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p")), "cg")
        rr = new
    return state.select("node", "x")


def propagate(parts: dict[str, DataFrame], features: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """(node, columns) after steps of the random walk on every feature: the graph convolution without weights."""
    both = cut(symmetric(parts["edges"]), "both")
    n, now = parts["nodes"], features.select("node", *columns)
    for _ in range(steps):
        x = now.withColumnRenamed("node", "dst")
        pulled = both.join(x, "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in columns])
        met = n.join(now, "node").join(pulled, "node", "left")
        loop = 1 / (F.col("q") * F.col("q"))
        now = cut(met.select("node", *[((F.coalesce(f"_{c}", F.lit(0.0)) + F.col(c) * loop) / F.col("degree")).alias(c) for c in columns]), "step")
    return now


def lists_for(n: int) -> int:
    """How many cells an index of n points gets: the square root, at least one."""
    return max(1, int(n**0.5))
