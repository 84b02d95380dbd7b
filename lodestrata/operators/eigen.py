"""Smallest eigenpairs of a symmetric matrix given by its entries, and how good they are.

Blocks of vectors are tables (node, x0, x1, ...). A restart draws a block through a Chebyshev filter, which grows what lies below a cut
against what lies above it, takes a short block Krylov (Lanczos) space of the result and solves the projected problem in it. For the products
nodes are dealt into parts by hash. A part's rows of the matrix and its numbers of the vectors stay where they are; in a product a node's
numbers go once to each other part that has a neighbour of it, packed, and nothing else moves. Only the moments of a space, as many as its
columns squared, reach the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import portable_hash
from ..plans.shared import cut, release

#: Vectors besides those asked for, steps of the Krylov space, the filter's degree in the first restart and its highest later, and the most that
#: a filter may grow one vector against another.
GUARD, STEPS, FIRST, DEGREE, GROWTH = 6, 2, 5, 40, 1e7
#: Most and least nodes of a part, and parts that are made while they have so many: cores share the work of smaller graphs, and what a node sends
#: does not begin to grow with their number. Then columns and steps of the space that bounds the spectrum.
PART, LEAST, SPREAD = 1 << 15, 512, 12
WIDE, LONG = 3, 10


def _names(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(width)]


def start_block(nodes: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(node, x0, ...): roughly normal numbers from hashes of the node, so that reruns agree."""

    def normal(k: int):
        h = portable_hash(seed * 1000 + k, "node")
        parts = [F.conv(F.substring(h, 1 + 8 * q, 8), 16, 10).cast("double") / 4294967296.0 - 0.5 for q in range(4)]
        return parts[0] + parts[1] + parts[2] + parts[3]

    return nodes.select("node", *[normal(k).alias(f"x{k}") for k in range(width)])


def _both(entries: DataFrame) -> DataFrame:
    return entries.select("i", "j", "v").unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def _product(both: DataFrame, block: DataFrame, names: list[str], carried: list[str]) -> DataFrame:
    """(node, l_<name> of the matrix times each named column, and all carried columns), from one join and one aggregation: what
    is carried comes along on the diagonal, which every row of the matrix has."""
    sums = [*[f"sum(v * {c}) AS l_{c}" for c in names], *[f"max(CASE WHEN i = j THEN {c} END) AS {c}" for c in carried]]
    return both.join(block, F.expr("j = node")).groupBy(F.col("i").alias("node")).agg(*map(F.expr, sums))


def _part(node: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts)).cast("int")


class Parts:
    """A symmetric matrix, every entry in both its places, dealt into parts of nodes. Of a part are kept `links`, which rows of its vectors each
    other part needs (those with an entry in it, as the matrix is symmetric), and `rows`, its entries row by row."""

    def __init__(self, both: DataFrame, parts: int):
        self.parts, self.kind = parts, both.schema["i"].dataType

        def build(table: pa.Table) -> pa.Table:
            p, q, v = table["p"][0].as_py(), table["q"].to_numpy(), table["v"].to_numpy()
            j = table["j"].to_numpy()
            nodes, row = np.unique(table["i"].to_numpy(), return_inverse=True)
            column, links, sources, at = np.empty(len(row), np.int64), {}, [], len(nodes)
            for other in map(int, np.unique(q)):
                here = q == other
                if other == p:
                    column[here] = np.searchsorted(nodes, j[here])
                    continue
                far, place = np.unique(j[here], return_inverse=True)
                column[here] = at + place
                at += len(far)
                links[other] = np.unique(row[here])
                sources.append(other)
            order = np.lexsort((column, row))
            starts = np.searchsorted(row[order], np.arange(len(nodes)))
            rows = nodes, sources, starts, column[order].astype(np.int32), v[order]
            return pa.table({"p": pa.array([p], pa.int32()), "links": [pickle.dumps(links)], "rows": [pickle.dumps(rows)]})

        placed = both.select(_part("i", parts).alias("p"), _part("j", parts).alias("q"), "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
        self.table = cut(placed.groupBy("p").applyInArrow(build, "p int, links binary, rows binary"), "parts")
        self.links, self.rows = self._dealt("links"), self._dealt("rows")

    def _dealt(self, name: str) -> RDD:
        dealt = self.table.select("p", name).rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(self.parts)
        # mapped after it is dealt, so that a union with vectors finds it in their form and does not read it through another process
        return dealt.mapValues(lambda piece: (name, pickle.loads(piece))).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.links.unpersist()
        self.rows.unpersist()
        release(self.table)

    def packed(self, block: DataFrame, names: list[str]) -> RDD:
        """The named columns of a table of nodes as one matrix a part, its rows by node."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, nodes = batch.column("p").to_numpy(), batch.column("node").to_numpy(zero_copy_only=False)
                x = np.column_stack([batch.column(c).to_numpy() for c in names])
                found = np.unique(part)
                pieces = [pickle.dumps((nodes[part == p], x[part == p])) for p in found]
                yield pa.RecordBatch.from_pydict({"p": found, "piece": pa.array(pieces, pa.binary())})

        def joined(items):
            items = list(items)
            if items:
                nodes, x = (np.concatenate(side) for side in zip(*(pickle.loads(piece) for _, piece in items), strict=True))
                yield items[0][0], ("state", [x[np.argsort(nodes, kind="stable")]])

        placed = block.select(_part("node", self.parts).alias("p"), "node", *names)
        pieces = placed.mapInArrow(split, "p int, piece binary").rdd.map(lambda r: (r[0], bytes(r[1])))
        return pieces.partitionBy(self.parts).mapPartitions(joined, preservesPartitioning=True)

    def stepped(self, state: RDD, mid: float, half: float, keep: bool, number: type) -> RDD:
        """One more step of the recurrence (keep: after all before it, else after the last one); other parts get `number`s."""

        def send(items):
            items = list(items)
            of = dict(item for _, item in items)
            for q, rows in of["links"].items() if items else ():
                yield q, (items[0][0], of["state"][-1][rows].astype(number))

        def step(items):
            items = list(items)
            if not items:
                return
            of = dict(item for _, item in items)
            _, sources, starts, column, v = of["rows"]
            old = of["state"]
            whole = np.concatenate([old[-1], *[of[q] for q in sources]])
            new = (np.add.reduceat(v[:, None] * whole[column], starts, axis=0) - mid * old[-1]) / half
            if len(old) > 1:
                new = 2 * new - old[-2]
            yield items[0][0], ("state", [*(old if keep else old[-1:]), new])

        sent = self.links.union(state).mapPartitions(send).partitionBy(self.parts)
        return self.rows.union(state).union(sent).mapPartitions(step, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def unpacked(self, state: RDD, names: list[str]) -> DataFrame:
        """(node, names) of the last columns of each part's vectors, as many as names."""

        def meet(items):
            of = dict(item for _, item in items)
            if of:
                yield (pickle.dumps((of["rows"][0], np.hstack(of["state"])[:, -len(names) :])),)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in batch.column("piece"):
                    nodes, x = pickle.loads(piece.as_py())
                    for at in range(0, len(nodes), 8192):
                        columns = {c: x[at : at + 8192, k] for k, c in enumerate(names)}
                        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[at : at + 8192]), **columns})

        pieces = self.table.sparkSession.createDataFrame(self.rows.union(state).mapPartitions(meet), "piece binary", verifySchema=False)
        return pieces.mapInArrow(spread, f"node {self.kind.simpleString()}, {', '.join(f'{c} double' for c in names)}")


def _recur(parts: Parts, block: DataFrame, width: int, steps: int, mid: float, half: float, keep: bool, number: type = np.float64) -> DataFrame:
    """Chebyshev polynomials of the matrix, scaled so that mid - half .. mid + half is -1 .. 1, times columns x: the last one as x
    (keep: each of them as b<step>_<column>, the zeroth included)."""
    states = [parts.packed(block, _names("x", width)).persist(StorageLevel.MEMORY_AND_DISK)]
    for _ in range(steps):
        states.append(parts.stepped(states[-1], mid, half, keep, number))
    names = [c for s in range(steps + 1) for c in _names(f"b{s}_", width)] if keep else _names("x", width)
    out = cut(parts.unpacked(states[-1], names), "space" if keep else "filtered")
    for state in states:
        state.unpersist()
    return out


def _moments(table: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
    """Inner products of columns a with columns b: partial matrices where the rows lie, summed entry by entry."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(a), len(b)))
        for batch in batches:
            m = np.column_stack([batch.column(c).to_numpy() for c in a]), np.column_stack([batch.column(c).to_numpy() for c in b])
            total += m[0].T @ m[1]
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "s": total.ravel()})

    out = np.zeros((len(a), len(b)))
    for row in table.select(*dict.fromkeys([*a, *b])).mapInArrow(of, "r int, c int, s double").groupBy("r", "c").agg(F.sum("s").alias("s")).collect():
        out[row["r"], row["c"]] = row["s"]
    return out


def _combined(table: DataFrame, outputs: dict[str, dict[str, float]]) -> DataFrame:
    """node and linear combinations of columns, as one small matrix product a batch."""
    inputs = list(dict.fromkeys(c for parts in outputs.values() for c in parts))
    m = np.array([[outputs[o].get(c, 0.0) for o in outputs] for c in inputs])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.column_stack([batch.column(c).to_numpy() for c in inputs]) @ m
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), **{o: made[:, k] for k, o in enumerate(outputs)}})

    kind = table.schema["node"].dataType.simpleString()
    return table.select("node", *inputs).mapInArrow(of, f"node {kind}, {', '.join(f'{o} double' for o in outputs)}")


def _ritz(space: DataFrame, width: int, steps: int, mid: float, half: float) -> tuple[np.ndarray, np.ndarray, list[dict], list[dict]]:
    """Of the matrix projected on blocks b0 .. b<steps - 1> of a space: values ascending, sizes of the residuals (to about 1e-7 of the matrix), and
    vectors and residuals as combinations of its columns."""
    cols = [_names(f"b{s}_", width) for s in range(steps + 1)]
    inside, everything = [c for block in cols[:-1] for c in block], [c for block in cols for c in block]
    # the matrix times a basis vector, in the basis one step longer
    image = np.zeros((len(everything), len(inside)))
    for s in range(steps):
        for k in range(width):
            b = s * width + k
            image[b, b] = mid
            image[b + width, b] = half if s == 0 else half / 2
            if s:
                image[b - width, b] = half / 2
    m = _moments(space, everything, everything)
    gram, h = m[: len(inside), : len(inside)], m[: len(inside)] @ image
    lam, q = np.linalg.eigh((gram + gram.T) / 2)
    good = lam > 1e-12 * lam[-1]
    white = q[:, good] / np.sqrt(lam[good])
    values, vec = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    coef = white @ vec
    wrong = image @ coef
    wrong[: len(inside)] -= coef * values
    sizes = np.sqrt(np.maximum(np.einsum("rk,rk->k", wrong, m @ wrong), 0.0))
    return values, sizes, [dict(zip(inside, c, strict=True)) for c in coef.T], [dict(zip(everything, c, strict=True)) for c in wrong.T]


def smallest(entries: DataFrame, modes: int, tolerance: float = 1e-7, restarts: int = 40, seed: int = 0) -> tuple[list[dict], DataFrame]:
    """(rows of mode, eigenvalue, residual), (node, x0, ...) of the smallest eigenvalues of a symmetric matrix.

    entries: (i, j, v), each off-diagonal entry once and every diagonal entry. Stops when every residual |A x - lambda x| is under tolerance
    times the bound on the largest eigenvalue; otherwise raises after so many restarts. Vectors have length one, their largest entry in size is
    positive (ties to the smaller node). A matrix with fewer rows than modes gives as many pairs as rows.
    """
    both = cut(_both(entries), "entries")
    spread = both.groupBy("i").agg(F.sum(F.abs("v")).alias("s"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)).alias("o"), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("d"))
    n, top, low = spread.agg(F.count("*"), F.max(F.col("d") + F.col("o")), F.min(F.col("d") - F.col("o"))).first()
    if not n:
        return [], entries.select(F.col("i").alias("node"))
    size = max(top, -low)
    modes = min(modes, n)
    width = full = min(n, modes + GUARD)
    parts = Parts(both, max(-(-n // PART), min(-(-n // LEAST), SPREAD)))
    nodes = both.where("i = j").select(F.col("i").alias("node"))
    # rows' sums bound the spectrum loosely; a filter over less needs fewer products. Should this bound be too low, restarts raise it
    top = max(top, low + (1e-3 * size or 1.0))
    mid, half, few = (top + low) / 2, (top - low) / 2, min(n, WIDE)
    space = _recur(parts, start_block(nodes, few, seed + 1), few, LONG, mid, half, keep=True)
    values, wrong, _, _ = _ritz(space, few, LONG, mid, half)
    release(space)
    low, top = max(low, values[0] - wrong[0]), min(top, values[-1] + wrong[-1])
    top = float(max(top, low + (1e-3 * size or 1.0)))
    low = float(low)
    # whatever the filter's numbers are rounded to, spaces and residuals are made in doubles
    number = np.float32 if tolerance >= 1e-8 else np.float64
    x = cut(start_block(nodes, width, seed), "block")
    edge, degree = low + 0.25 * (top - low), FIRST
    for _ in range(restarts):
        v0 = _recur(parts, x, width, degree, (top + edge) / 2, (top - edge) / 2, keep=False, number=number)
        mid, half = (top + low) / 2, (top - low) / 2
        # filtered columns differ in size by orders of magnitude and lean on each other: made of one size and orthonormal first
        m = _moments(v0, _names("x", width), _names("x", width))
        scale = 1 / np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        lam, q = np.linalg.eigh(m * scale * scale[:, None])
        good = lam > 1e-13 * lam[-1]
        white = scale[:, None] * q[:, good] / np.sqrt(lam[good])
        held = int(good.sum())
        straight = _combined(v0, {f"x{k}": {f"x{r}": white[r, k] for r in range(width)} for k in range(held)})
        space = _recur(parts, straight, held, STEPS + 1, mid, half, keep=True)
        values, _, coef, wrong = _ritz(space, held, STEPS + 1, mid, half)
        keep = min(full, len(values))
        new = cut(_combined(space, {f"x{k}": coef[k] for k in range(keep)} | {f"r{k}": wrong[k] for k in range(keep)}), "ritz")
        residual = new.agg(*[F.sqrt(F.sum(F.col(f"r{k}") * F.col(f"r{k}"))) for k in range(keep)]).first()
        for old in (x, v0, space):
            release(old)
        x, width = new.select("node", *_names("x", keep)), keep
        if len(residual) >= modes and max(residual[:modes]) <= tolerance * size:
            break
        top = max(top, float(values[-1]))
        edge = min(float(values[keep - 1]) + 1e-3 * (top - low), top - 0.05 * (top - low))
        reach = np.arccosh(max(1.0, 1 + 2 * (edge - float(values[0])) / (top - edge)))
        degree = int(np.clip(np.arccosh(GROWTH) / max(reach, 1e-9), FIRST, DEGREE))
    else:
        raise RuntimeError(f"residuals {list(residual[:modes])} after {restarts} restarts")
    parts.release()
    signs = x.agg(*[F.max(F.struct(F.abs(f"x{k}").alias("a"), (-F.col("node")).alias("n"), F.col(f"x{k}").alias("x"))).alias(f"s{k}") for k in range(modes)]).first()
    flipped = x.select("node", *[(F.col(f"x{k}") * (1.0 if signs[f"s{k}"]["x"] >= 0 else -1.0)).alias(f"x{k}") for k in range(modes)])
    return [{"mode": k, "eigenvalue": float(values[k]), "residual": float(residual[k])} for k in range(modes)], flipped


def orthonormality_error(vectors: DataFrame) -> float:
    """The largest entry in size of X'X - I."""
    names = [c for c in vectors.columns if c != "node"]
    return float(np.abs(_moments(vectors, names, names) - np.eye(len(names))).max())


def residuals(entries: DataFrame, vectors: DataFrame, values: list[float]) -> list[float]:
    """|A x - lambda x| / |x| of each vector, by one product with the matrix."""
    names = [c for c in vectors.columns if c != "node"]
    made = _product(cut(_both(entries), "entries"), vectors, names, names)
    sums = [F.sqrt(F.sum(F.pow(F.col(f"l_{c}") - lam * F.col(c), F.lit(2))) / F.sum(F.col(c) * F.col(c))) for c, lam in zip(names, values, strict=True)]
    return list(made.agg(*sums).first())


def principal_angles(a: DataFrame, b: DataFrame) -> list[float]:
    """Angles in degrees, ascending, between the spaces that two blocks of vectors over the same nodes span."""
    left, right = [c for c in a.columns if c != "node"], [c for c in b.columns if c != "node"]
    met = cut(a.join(b.select("node", *[F.col(c).alias(f"o_{c}") for c in right]), "node"), "spaces")
    other = [f"o_{c}" for c in right]
    roots = [np.linalg.inv(np.linalg.cholesky(_moments(met, names, names))) for names in (left, other)]
    cosines = np.linalg.svd(roots[0] @ _moments(met, left, other) @ roots[1].T, compute_uv=False)
    return [float(v) for v in np.degrees(np.arccos(np.clip(cosines, -1.0, 1.0)))]
