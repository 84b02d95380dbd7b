"""Entropic optimal transport between sections: the plan of least cost plus eps times entropy that carries one section's mass onto the next.

All pairs of sections are solved at once by alternating scalings in logarithms. Sections are packed into blocks of at most BLOCK rows; a
half step is one job over pairs of blocks, each of which works out its part of the kernel anew and leaves a maximum and a sum for every row, and
the parts of a row meet by aggregation. No plan is ever held: what it says (cost, marginals, where mass goes) is summed block by block.

Where sections are large against the cells that they fill, of the width of the kernel, no pair of rows is worked out: the kernel between two cells is
a product of one row's powers and the other's, up to a degree that leaves out less than rounding does, so rows send moments to the other side's cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, release

#: Rows in a block, and full iterations between two looks at the marginals.
BLOCK, CHAIN = 2048, 5


def _pack(dims: int):
    def of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(dims)])
        ids = np.ascontiguousarray(rows.column("key").to_numpy(), dtype=np.int64)
        return pa.table({"section": rows.column("section")[:1], "blk": rows.column("blk")[:1], "n": pa.array([rows.num_rows]), "total": rows.column("total")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    return of


def _kernel(row: dict, dims: int, eps: float) -> np.ndarray:
    a, b = (np.frombuffer(row[c]).reshape(-1, dims) for c in ("xa", "xb"))
    out = np.zeros((len(a), len(b)))
    for i in range(dims):
        gap = a[:, i, None] - b[None, :, i]
        out += gap * gap
    return out / eps


def _parts(dims: int, eps: float, onto_a: bool):
    """mapInArrow: pairs of blocks with the other side's potential -> (pair, blk, maximum and sum a row)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"pair": [], "blk": [], "top": [], "sum": []}
            for row in batch.to_pylist():
                c = _kernel(row, dims, eps)
                away = np.frombuffer(row["pot"]) - np.log(row["nb" if onto_a else "na"])
                part = (away[None, :] - c) if onto_a else (away[None, :] - c.T)
                top = part.max(axis=1)
                for k, v in (("pair", row["pair"]), ("blk", row["ba" if onto_a else "bb"]), ("top", top.tobytes()), ("sum", np.exp(part - top[:, None]).sum(axis=1).tobytes())):
                    out[k].append(v)
            if out["pair"]:
                yield pa.RecordBatch.from_pydict({"pair": pa.array(out["pair"], pa.int64()), "blk": pa.array(out["blk"], pa.int32()), "top": pa.array(out["top"], pa.binary()), "sum": pa.array(out["sum"], pa.binary())})

    return of


def _merged(parts: pa.Table) -> pa.Table:
    """All parts of one block's rows -> the potential that gives them their mass."""
    tops = np.array([np.frombuffer(v) for v in parts.column("top").to_pylist()])
    sums = np.array([np.frombuffer(v) for v in parts.column("sum").to_pylist()])
    top = tops.max(axis=0)
    pot = -(top + np.log((sums * np.exp(tops - top)).sum(axis=0)))
    return pa.table({"pair": parts.column("pair")[:1], "blk": parts.column("blk")[:1], "pot": pa.array([pot.tobytes()], pa.binary())})


_POT = "pair long, blk int, pot binary"


class _Blocks:
    """Half steps over all pairs of blocks."""

    def __init__(self, rows: DataFrame, sizes: DataFrame, named: DataFrame, dims: int, eps: float):
        self.dims, self.eps = dims, eps
        dealt = rows.join(sizes, "section").withColumn("blk", F.pmod(F.xxhash64("key"), F.ceil(F.col("total") / BLOCK)).cast("int"))
        self.blocks = cut(dealt.groupBy("section", "blk").applyInArrow(_pack(self.dims), "section long, blk int, n long, total long, ids binary, x binary"), "blocks")
        a = self.blocks.select(F.col("section").alias("a"), F.col("blk").alias("ba"), F.col("total").alias("na"), F.col("x").alias("xa"))
        b = self.blocks.select(F.col("section").alias("b"), F.col("blk").alias("bb"), F.col("total").alias("nb"), F.col("x").alias("xb"))
        self.pairs = cut(named.join(a, "a").join(b, "b"), "block-pairs")

    def start(self) -> DataFrame:
        # any start will do; a row of zeros for each block of b
        v = self.pairs.groupBy("pair", F.col("bb").alias("blk")).agg(F.first(F.length("xb")).alias("bytes"))
        return cut(v.select("pair", "blk", F.expr(f"unhex(repeat('00', cast(bytes / {self.dims} as int)))").alias("pot")), "start")

    def half(self, pot: DataFrame, onto_a: bool) -> DataFrame:
        other = "bb" if onto_a else "ba"
        met = self.pairs.join(pot.withColumnRenamed("blk", other), ["pair", other])
        return met.mapInArrow(_parts(self.dims, self.eps, onto_a), "pair long, blk int, top binary, sum binary").groupBy("pair", "blk").applyInArrow(_merged, _POT)

    def errors(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """(pair, error): how far the mass of a's rows is from what it should be under the potentials `old`, by those that would mend it."""
        totals = self.pairs.select("pair", F.col("ba").alias("blk"), "na").distinct()

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                off = [float(np.abs(np.expm1(np.frombuffer(r["pot"]) - np.frombuffer(r["mend"]))).sum() / r["na"]) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pydict({"pair": batch.column("pair"), "off": pa.array(off, pa.float64())})

        met = old.join(new.withColumnRenamed("pot", "mend"), ["pair", "blk"]).join(totals, ["pair", "blk"])
        return met.mapInArrow(of, "pair long, off double").groupBy("pair").agg(F.sum("off").alias("error"))

    def carried(self, u: DataFrame, v: DataFrame) -> DataFrame:
        dims, eps = self.dims, self.eps
        ids = self.blocks.select(F.col("section").alias("a"), F.col("blk").alias("ba"), "ids")
        met = self.pairs.join(u.select("pair", F.col("blk").alias("ba"), F.col("pot").alias("u")), ["pair", "ba"]).join(v.select("pair", F.col("blk").alias("bb"), F.col("pot").alias("v")), ["pair", "bb"]).join(ids, ["a", "ba"])

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    c = _kernel(row, dims, eps)
                    plan = np.exp(np.frombuffer(row["u"])[:, None] + np.frombuffer(row["v"])[None, :] - c) / (row["na"] * row["nb"])
                    y = np.frombuffer(row["xb"]).reshape(-1, dims)
                    at = np.frombuffer(row["ids"], dtype=np.int64)
                    sums = plan @ y
                    yield pa.RecordBatch.from_pydict({"a": np.full(len(at), row["a"]), "b": np.full(len(at), row["b"]), "key": at, "mass": plan.sum(axis=1), "cost": (plan * c).sum(axis=1) * eps, **{f"y{i}": sums[:, i] for i in range(dims)}})

        names = [f"y{i}" for i in range(dims)]
        parts = met.mapInArrow(of, f"a long, b long, key long, mass double, cost double, {', '.join(f'{n} double' for n in names)}")
        sums = parts.groupBy("a", "b", "key").agg(*[F.sum(c).alias(c) for c in ["mass", "cost", *names]])
        return sums.select("a", "b", "key", "mass", "cost", *[(F.col(n) / F.col("mass")).alias(n) for n in names])


class _Expansion:
    """exp(2 s.t / eps) of offsets s, t within cells of side sqrt(eps) as an inner product of powers: what is left out is under 1e-16 of it."""

    def __init__(self, dims: int, eps: float):
        self.dims, self.eps, self.side = dims, eps, float(np.sqrt(eps))
        self.degree = next(p for p in range(200) if (dims / 2) ** (p + 1) / factorial(p + 1) * np.exp(dims / 2) < 1e-16)
        self.size = comb(self.degree + dims, dims)

    def centre(self, cell: str) -> np.ndarray:
        return (np.array(cell.split(","), dtype=float) + 0.5) * self.side

    def powers(self, offsets: np.ndarray) -> np.ndarray:
        if not hasattr(self, "exponents"):  # made in the task
            self.exponents = np.array([e for e in product(range(self.degree + 1), repeat=self.dims) if sum(e) <= self.degree])
        z, out = np.sqrt(2 / self.eps) * offsets, np.ones((len(offsets), self.size))
        for i in range(self.dims):
            one = np.ones((len(z), self.degree + 1))
            for k in range(1, self.degree + 1):
                one[:, k] = one[:, k - 1] * z[:, i] / np.sqrt(k)
            out *= one[:, self.exponents[:, i]]
        return out

    def received(self, x: np.ndarray, cell: str, row: dict, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of what each source cell sends to each row, its moments over the first of them, source centres)."""
        m = np.frombuffer(row["m"]).reshape(-1, self.size, width)
        centres = np.array([self.centre(c) for c in row["sources"]])
        got = np.einsum("nf,kfw->nkw", self.powers(x - self.centre(cell)), m, optimize=True)
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2) / self.eps
        return np.log(np.maximum(got[:, :, 0], 1e-300)) + np.frombuffer(row["tops"]) - far, got / got[:, :, :1], centres

    def potential(self, x: np.ndarray, row: dict) -> np.ndarray:
        if row["m"] is None:
            return np.zeros(len(x))
        logs = self.received(x, row["cell"], row)[0]
        top = logs.max(axis=1)
        return -(top + np.log(np.exp(logs - top[:, None]).sum(axis=1)))


class _Cells:
    """Half steps through moments of cells. A potential is what the moments that reached a row's cell make it, so those are all that is kept."""

    def __init__(self, rows: DataFrame, named: DataFrame, way: _Expansion):
        self.way, dims = way, way.dims
        counts = rows.groupBy("section", "cell").agg(F.count("*").alias("held"))
        totals = counts.groupBy("section").agg(F.sum("held").alias("total"))
        cells = counts.groupBy(F.col("section").alias("other")).agg(F.sort_array(F.collect_set("cell")).alias("targets"))
        dealt = rows.join(counts, ["section", "cell"]).join(totals, "section").withColumn("blk", F.pmod(F.xxhash64("key"), F.ceil(F.col("held") / BLOCK)).cast("int"))
        packed = dealt.groupBy("section", "cell", "blk").applyInArrow(lambda t: _pack(dims)(t).append_column("cell", t.column("cell")[:1]), "section long, blk int, n long, total long, ids binary, x binary, cell string")
        packed = cut(packed, "blocks")
        side = lambda own, other: cut(named.withColumn("other", F.col(other)).join(packed.withColumnRenamed("section", own), own).join(cells, "other").drop("other"), "sides")
        self.sides = {True: side("b", "a"), False: side("a", "b")}

    def start(self) -> None:
        return None

    def _met(self, side: DataFrame, state: DataFrame | None) -> DataFrame:
        if state is None:
            return side.selectExpr("*", "cast(null as array<string>) AS sources", "cast(null as binary) AS tops", "cast(null as binary) AS m")
        return side.join(state, ["pair", "cell"])

    def half(self, state: DataFrame | None, onto_a: bool, moments: bool = False) -> DataFrame:
        """(pair, cell, sources, tops, m) for the cells of the side that is reached; moments: of positions and squares too."""
        way, size, width = self.way, self.way.size, 2 + self.way.dims if moments else 1

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x, own = np.frombuffer(row["x"]).reshape(-1, way.dims), way.centre(row["cell"])
                    off = x - own
                    square = (off * off).sum(axis=1)
                    base = way.potential(x, row) - np.log(row["total"]) - square / way.eps
                    powers, weights = way.powers(off), np.column_stack([np.ones(len(x)), off, square])[:, :width]
                    tops, sums = [], []
                    for cell in row["targets"]:
                        logs = base + 2 / way.eps * (off @ (way.centre(cell) - own))
                        tops.append(float(logs.max()))
                        sums.append((powers.T @ (np.exp(logs - tops[-1])[:, None] * weights)).tobytes())
                    many = len(tops)
                    yield pa.RecordBatch.from_pydict({"pair": [row["pair"]] * many, "cell": row["targets"], "source": [row["cell"]] * many, "top": tops, "m": pa.array(sums, pa.binary())})

        def merge(t: pa.Table) -> pa.Table:
            top, m = t.column("top").to_numpy(), np.array([np.frombuffer(v) for v in t.column("m").to_pylist()])
            sources, at = np.unique(np.array(t.column("source").to_pylist()), return_inverse=True)
            tops, total = np.full(len(sources), -np.inf), np.zeros((len(sources), size * width))
            np.maximum.at(tops, at, top)
            np.add.at(total, at, m * np.exp(top - tops[at])[:, None])
            return pa.table({"pair": t.column("pair")[:1], "cell": t.column("cell")[:1], "sources": pa.array([sources.tolist()], pa.list_(pa.string())), "tops": pa.array([tops.tobytes()], pa.binary()), "m": pa.array([total.tobytes()], pa.binary())})

        sent = self._met(self.sides[onto_a], state).select("pair", "cell", "x", "total", "targets", "sources", "tops", "m").mapInArrow(send, "pair long, cell string, source string, top double, m binary")
        return sent.groupBy("pair", "cell").applyInArrow(merge, "pair long, cell string, sources array<string>, tops binary, m binary")

    def errors(self, old: DataFrame, new: DataFrame) -> DataFrame:
        way = self.way

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                off = []
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"]).reshape(-1, way.dims)
                    mend = {"cell": row["cell"], "sources": row["s2"], "tops": row["t2"], "m": row["m2"]}
                    off.append(float(np.abs(np.expm1(way.potential(x, row) - way.potential(x, mend))).sum() / row["total"]))
                yield pa.RecordBatch.from_pydict({"pair": batch.column("pair"), "off": pa.array(off, pa.float64())})

        met = self._met(self._met(self.sides[False], old), new.withColumnsRenamed({"sources": "s2", "tops": "t2", "m": "m2"}))
        return met.mapInArrow(of, "pair long, off double").groupBy("pair").agg(F.sum("off").alias("error"))

    def carried(self, u: DataFrame, v: DataFrame) -> DataFrame:
        way, names = self.way, [f"y{i}" for i in range(self.way.dims)]
        sent = cut(self.half(v, True, moments=True), "moments").withColumnsRenamed({"sources": "s2", "tops": "t2", "m": "m2"})

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"]).reshape(-1, way.dims)
                    logs, mean, centres = way.received(x, row["cell"], {"sources": row["s2"], "tops": row["t2"], "m": row["m2"]}, 2 + way.dims)
                    part = np.exp(logs + way.potential(x, row)[:, None]) / row["total"]
                    gap, step = x[:, None] - centres[None], mean[:, :, 1:-1]
                    cost = (gap * gap).sum(axis=2) - 2 * (gap * step).sum(axis=2) + mean[:, :, -1]
                    mass, y = part.sum(axis=1), (part[:, :, None] * (centres[None] + step)).sum(axis=1)
                    at = np.frombuffer(row["ids"], dtype=np.int64)
                    yield pa.RecordBatch.from_pydict({"a": np.full(len(at), row["a"]), "b": np.full(len(at), row["b"]), "key": at, "mass": mass, "cost": (part * cost).sum(axis=1), **{n: y[:, i] / mass for i, n in enumerate(names)}})

        met = self._met(self._met(self.sides[False], u), sent)
        return met.mapInArrow(of, f"a long, b long, key long, mass double, cost double, {', '.join(f'{n} double' for n in names)}")


class Transport:
    """Potentials of every pair (a, b) of sections, solved to a marginal error of `tolerance` (sum over rows, after the columns are exact).

    points: section, key (integers) and coordinates, one row a point, of equal mass within its section; pairs: a, b. The cost of a step is its squared
    length. Pairs with an empty side are left out, and so are rows with nulls. Raises if some pair is not settled after so many rounds.
    """

    def __init__(self, points: DataFrame, section: str, key: str, coords: list[str], pairs: DataFrame, eps: float, tolerance: float = 1e-6, rounds: int = 2000):
        dims, way = len(coords), _Expansion(len(coords), eps)
        rows = points.select(F.col(section).cast("long").alias("section"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coords)]).dropna()
        named = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct().withColumn("pair", F.xxhash64("a", "b"))
        placed = rows.withColumn("cell", F.concat_ws(",", *[F.floor(F.col(f"x{i}") / way.side) for i in range(dims)]))
        sizes = placed.groupBy("section").agg(F.count("*").alias("total"), F.countDistinct("cell").alias("cells"))
        a, b = (sizes.toDF(c, f"n{c}", f"c{c}") for c in "ab")
        work = named.join(a, "a").join(b, "b").agg(F.sum(F.col("na").cast("double") * F.col("nb")), F.sum((F.col("na") * F.col("cb") + F.col("nb") * F.col("ca")).cast("double") * way.size)).first()
        self.cells = work[0] is not None and work[1] < work[0]
        self.steps = steps = _Cells(placed, named, way) if self.cells else _Blocks(rows, sizes.drop("cells"), named, dims, eps)
        v, done = steps.start(), 0
        while True:
            for _ in range(CHAIN - 1):
                v = steps.half(steps.half(v, True), False)
            v = cut(v, "scaling")
            u = cut(steps.half(v, True), "scaling")
            new_v = cut(steps.half(u, False), "scaling")
            again = cut(steps.half(new_v, True), "scaling")
            done += CHAIN
            worst = steps.errors(u, again).agg(F.max("error")).first()[0]
            self.u, self.v = u, new_v
            if worst is None or worst <= tolerance:
                break
            if done >= rounds:
                raise RuntimeError(f"marginals are off by {worst} after {done} rounds")
            release(v)
            v = new_v

    def carried(self) -> DataFrame:
        """(a, b, key, mass, cost, y0, ...) of every row of a: its mass under the plan, its share of the cost, and where on average it goes."""
        return self.steps.carried(self.u, self.v)


def between(carried: DataFrame, points: DataFrame, section: str, key: str, coords: list[str], share: float) -> DataFrame:
    """(a, b, key, coords): the rows of each section moved a share of their way to the next one."""
    own = points.select(F.col(section).cast("long").alias("a"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(coords)])
    moved = [(F.col(f"_x{i}") + share * (F.col(f"y{i}") - F.col(f"_x{i}"))).alias(c) for i, c in enumerate(coords)]
    return carried.join(own, ["a", "key"]).select("a", "b", "key", *moved)
