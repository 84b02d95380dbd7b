"""Mixing sources to target weights by Pareto order sampling.

Within a source a document is expected c * x times, where x is the number of binary digits of its
word count (long documents say more that is said once, but not in proportion) and c is set so that the
expected words are the source's target; nothing is expected more than `most` times. The whole part is
taken for certain. What is left, f, is the document's own inclusion probability: all documents of a
source are ranked together by random odds over inclusion odds, (U / (1 - U)) / (f / (1 - f)) with
a uniform U from a hash of the row, and taken in that order as far as their words fit the target. Words
that are still missing, beyond a tolerance, are filled from long documents to short ones and within a size class
in the same order.

Only words by rank bucket are gathered: two levels of buckets find where a source is cut, so
that exact places are worked out for a few rows in each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bins import global_rank
from ..plans.shared import cut, cut_narrow, fresh, stored_bytes
from .common import WORD, quoted, table

#: Weights in the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Rank buckets of a source, and parts of the one bucket where it is cut.
BUCKETS = 4096
#: Words missing of a target that are left missing: filling them with the shortest documents would take those too often.
TOLERANCE = 0.001
#: Documents of one size class that may fill what is missing. Entering a class with twice its upper bound missing, three are enough.
FILLERS = 8
#: A table about sources is broadcast up to this size on disk; a larger one is joined by shuffle.
BROADCAST_BYTES = 4 << 20


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of distinct sources.

    Shares follow the weights; a target stops at `most` times its source's size, and the excess goes to the
    others by weight. That is a water level L with target = min(cap, L * weight). Rounds of one aggregation
    each close the sources that are above their caps, until none is; only the sums of a round reach the driver.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    facts = cut(ranked.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap")), "weights")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = facts.agg(F.sum(wide("source_size"))).first()[0] or 0
    rest, w_rest, closed = total, 0, -1
    above = F.lit(False)
    while True:
        row = facts.agg(F.sum(F.when(above, wide("cap"))).alias("cap"), F.sum(F.when(~above, wide("w"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        rest, w_rest = int(total) - int(row["cap"] or 0), int(row["w"] or 0)
        if row["n"] == closed or not w_rest:
            break
        closed = row["n"]
        above = wide("cap") * F.lit(w_rest) < F.lit(rest).cast("decimal(38,0)") * wide("w")
    part = F.lit(float(rest)) * F.col("w") / F.lit(float(w_rest or 1))
    return facts.select("source", "source_size", F.least(F.col("cap").cast("double"), part).alias("target"))


def uniform(seed: int, who: Column, nth: Column) -> Column:
    """A number in (0, 1) from the md5 of a row's name and number, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), who, nth.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def pareto_key(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds; the smallest keys are taken. Null where nothing can be drawn."""
    return F.try_divide(u / (1 - u), F.try_divide(inclusion, 1 - inclusion))


def name_of_row() -> Column:
    """What rows that are equal in source, doc_id and text share."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", text("source"), text("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def numbered(docs: DataFrame, who: str, nth: str) -> DataFrame:
    """docs with the name of each row (who) and a number that tells rows of one name apart (nth, from 0).

    Names repeat only where ids do, so a count of ids finds the rows to look at. Those are written once and numbered
    inside the parts they were written in, each part starting where the ones before it end: no task holds a name.
    """
    named = docs.withColumn(who, name_of_row())
    id_, n, part, order, before = fresh(named, "_ls_id", "_ls_n", "_ls_part", "_ls_order", "_ls_before")
    ids = cut_narrow(docs.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_), "ids")
    if ids.isEmpty():
        return named.withColumn(nth, F.lit(0).cast("long"))
    ids = F.broadcast(ids) if stored_bytes(ids) <= BROADCAST_BYTES else ids
    again = F.col("doc_id").eqNullSafe(F.col(id_))
    once = named.join(ids, again, "left_anti").withColumn(nth, F.lit(0).cast("long"))
    held = named.join(ids, again, "left_semi").withColumn(part, F.spark_partition_id())
    held = cut(held.withColumn(order, F.xxhash64(*quoted(docs.columns))), "repeats")
    starts = held.groupBy(who, part).agg(F.count("*").alias(n))
    starts = starts.withColumn(before, F.sum(n).over(Window.partitionBy(who).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    local = held.withColumn(n, F.row_number().over(Window.partitionBy(who, part).orderBy(order)) - 1)
    met = local.join(starts.select(who, part, before), [who, part])
    met = met.withColumn(nth, F.coalesce(before, F.lit(0)).cast("long") + F.col(n))
    return once.unionByName(met.select(*quoted(docs.columns), who, nth))


def _place(key: Column, size: Column, who: Column, nth: Column) -> Column:
    """A row's place among its source's: by Pareto key, ties by size and name."""
    return F.struct(key.alias("key"), size.alias("size"), who.alias("who"), nth.alias("nth"))


class Mix:
    """What decides how often a row is taken: one table about sources and size classes, and nothing about rows."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7):
        """docs: a table with doc_id, source, text and any others."""
        self.docs, self.seed = docs, seed
        self.own, self.about = fresh(docs, "_ls_own", "_ls_about")
        who, nth = fresh(docs, "_ls_who", "_ls_nth")
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
        facts = F.struct(size.alias("size"), F.col(who).alias("who"), F.col(nth).alias("nth"))
        self.rows = numbered(docs, who, nth).withColumn(self.own, facts).drop(who, nth)
        self.narrow = cut_narrow(self.rows.select("doc_id", "source", f"{self.own}.*").withColumn("x", _digits(F.col("size"))), "sizes")
        self.facts = self._expected(weights, most)
        self.cuts = self._decide()

    def _expected(self, weights: tuple[int, ...], most: int) -> DataFrame:
        """source, x, source_size, target, whole and f of a size class's documents, and the words that sampling has to bring its source."""
        strata = cut_narrow(self.narrow.groupBy("source", "x").agg(F.sum("size").alias("words")), "strata")
        goals = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("source", "_s")
        classes = strata.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        down = Window.partitionBy("source").orderBy(F.col("x").desc())
        above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.col("target") - most * above
        weight = F.sum(F.col("x") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
        classes = classes.withColumn("rest", rest).withColumn("weight", weight)
        # the largest class that stays below `most` copies sets the level
        fits = F.col("rest") * F.col("x") <= most * F.col("weight").cast("double")
        every = Window.partitionBy("source")
        level = F.max(F.when(fits & (F.col("weight") > 0), F.struct("x", F.try_divide(F.col("rest"), F.col("weight"))))).over(every)
        classes = classes.withColumn("e", F.least(F.lit(float(most)), F.coalesce(level["col2"], F.lit(0.0)) * F.col("x")))
        classes = classes.withColumn("whole", F.floor("e").cast("long")).withColumn("f", F.col("e") - F.col("whole"))
        gap = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)
        return cut_narrow(classes.select("source", "x", "source_size", "target", "whole", "f", gap.alias("gap")), "facts")

    def _decide(self) -> DataFrame:
        """source, x with all that a row needs: whole, f, the edge bucket and the last place taken in it, and the rows that fill up."""
        small = stored_bytes(self.facts) <= BROADCAST_BYTES
        met = _meet(self.narrow.where("size > 0"), self.facts.select("source", "x", "f", "gap").where("f > 0"), ("source", "x"), small)
        key = pareto_key(uniform(self.seed, F.col("who"), F.col("nth")), F.col("f"))
        drawn = cut(met.select("source", "x", "size", "who", "nth", "gap", key.alias("key"), _bucket(key).alias("b")), "drawn")
        sources = self.facts.groupBy("source").agg(F.max("gap").alias("gap"))
        first = self._edge(drawn.withColumn("b", F.floor(F.col("b") / BUCKETS)), sources.withColumn("base", F.lit(0).cast("long")))
        inside = _meet(drawn, first.select("source", F.col("edge").alias("e1")), ("source",), small).where(F.floor(F.col("b") / BUCKETS) == F.col("e1"))
        second = cut_narrow(self._edge(inside, first.select("source", "gap", "base")), "edges")
        # a source without an edge takes all it ranks; one whose first bucket is cut has its base there
        at_edge = _meet(inside.drop("gap"), second.select("source", "edge", "base", "gap"), ("source",), small).where("b = edge")
        place = _place(*map(F.col, ("key", "size", "who", "nth")))
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        last = at_edge.withColumn("upto", upto).where("upto <= gap").groupBy("source").agg(F.max(place).alias("place"), F.max("upto").alias("upto"))
        state = _meet(second, last, ("source",), False, "left")
        taken = F.coalesce("upto", "base")
        state = state.select("source", F.coalesce("edge", F.lit(BUCKETS * BUCKETS)).alias("edge"), "place", (F.col("gap") - taken).alias("left"))
        own = self.facts.select("source", "x", "whole", "f", (F.col("target") * TOLERANCE).alias("slack"))
        state = cut_narrow(_meet(own, state, ("source",), False), "state")
        small = stored_bytes(state) <= BROADCAST_BYTES
        # fillers: the next rows of each class that could still fit
        rest = _meet(drawn.drop("gap"), state.select("source", "x", "edge", "place", "left", "slack"), ("source", "x"), small)
        rest = rest.where(~_taken(F.col("b"), place, F.col("edge"), F.col("place")) & (F.col("size") <= F.col("left")))
        nth = F.row_number().over(Window.partitionBy("source", "x").orderBy(place))
        next_ = rest.withColumn("k", nth).where(F.col("k") <= FILLERS)
        filled = next_.groupBy("source").agg(F.max("left").alias("left"), F.max("slack").alias("slack"), F.sort_array(F.collect_list(F.struct((-F.col("x")).alias("down"), place.alias("place")))).alias("all"))
        start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<who:string,nth:bigint>>").alias("fill"))

        def step(s: Column, r: Column) -> Column:
            row = F.struct(r["place"]["who"].alias("who"), r["place"]["nth"].alias("nth"))
            more = F.struct((s["left"] - r["place"]["size"]).alias("left"), F.concat(s["fill"], F.array(row)).alias("fill"))
            return F.when((s["left"] > F.col("slack")) & (r["place"]["size"] <= s["left"]), more).otherwise(s)

        filled = filled.select("source", F.aggregate("all", start, step)["fill"].alias("fill"))
        cuts = _meet(state.drop("left", "slack"), filled, ("source",), False, "left")
        return cut_narrow(cuts.withColumn("fill", F.coalesce("fill", F.array().cast("array<struct<who:string,nth:bigint>>"))), "cuts")

    @staticmethod
    def _edge(rows: DataFrame, sources: DataFrame) -> DataFrame:
        """For rows (source, b, size) and sources (source, gap, base): the bucket where the words taken in order of b would exceed
        gap (null: nowhere), and in base the words before it."""
        held = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        sums = _meet(held.withColumn("upto", upto), sources, ("source",), False)
        sums = sums.withColumn("over", F.col("base") + F.col("upto") > F.col("gap"))
        found = sums.groupBy("source").agg(F.min(F.when(F.col("over"), F.col("b"))).alias("edge"), F.max(F.when(~F.col("over"), F.col("base") + F.col("upto"))).alias("full"))
        met = _meet(sources, found, ("source",), False, "left")
        return met.select("source", "gap", "edge", F.coalesce("full", "base").alias("base"))

    def _copies(self, size: Column, x: Column, who: Column, nth: Column, about: str) -> Column:
        c = lambda name: F.col(f"{about}.{name}")
        key = pareto_key(uniform(self.seed, who, nth), c("f"))
        drawn = (size > 0) & (c("f") > 0)
        sampled = _taken(_bucket(key), _place(key, size, who, nth), c("edge"), c("place"))
        filled = F.array_contains(c("fill"), F.struct(who.alias("who"), nth.alias("nth")))
        return c("whole") + F.when(drawn & (sampled | filled), 1).otherwise(0)

    def rows_taken(self) -> DataFrame:
        """doc_id, source, size, copies, source_size, target of every row."""
        small = stored_bytes(self.cuts) <= BROADCAST_BYTES
        about = self.cuts.join(self.facts.select(F.col("source").alias("_s"), F.col("x").alias("_x"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("x") == F.col("_x")))
        packed = _packed(about.drop("_s", "_x"), "about")
        met = self.narrow.join(F.broadcast(packed) if small else packed, F.col("source").eqNullSafe(F.col("about.source")) & (F.col("x") == F.col("about.x")))
        copies = self._copies(F.col("size"), F.col("x"), F.col("who"), F.col("nth"), "about")
        return met.select("doc_id", "source", "size", copies.alias("copies"), "about.source_size", "about.target")

    def docs_taken(self) -> DataFrame:
        """Every row of docs as often as it is taken."""
        small = stored_bytes(self.cuts) <= BROADCAST_BYTES
        packed = _packed(self.cuts, self.about)
        own = lambda name: F.col(f"{self.own}.{name}")
        x = _digits(own("size"))
        met = self.rows.join(F.broadcast(packed) if small else packed, F.col("source").eqNullSafe(F.col(f"{self.about}.source")) & (x == F.col(f"{self.about}.x")))
        copies = self._copies(own("size"), x, own("who"), own("nth"), self.about)
        again = F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(self.own)
        columns = quoted(self.docs.columns)
        return met.where(copies > 0).select(*columns, again).select(*columns)


def _digits(size: Column) -> Column:
    """Binary digits of a word count; no words count as one."""
    return F.length(F.bin(F.greatest(size, F.lit(1).cast("long")))).cast("long")


def _bucket(key: Column) -> Column:
    """Keys in BUCKETS * BUCKETS parts, in their order; about as many below 1, where draws end, as above."""
    return F.floor(key / (1 + key) * float(BUCKETS * BUCKETS))


def _taken(b: Column, place: Column, edge: Column, last: Column) -> Column:
    return (b < edge) | ((b == edge) & F.coalesce(place <= last, F.lit(False)))


def _meet(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...], small: bool, how: str = "inner") -> DataFrame:
    """rows of an internal table with what is known about their source (and class); a join by shuffle splits a hot source by AQE."""
    own = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    cond = F.col("source").eqNullSafe(F.col("_of_source"))
    for k in keys[1:]:
        cond = cond & (F.col(k) == F.col(f"_of_{k}"))
    return rows.join(F.broadcast(own) if small else own, cond, how).drop(*[f"_of_{k}" for k in keys])


def _packed(df: DataFrame, name: str) -> DataFrame:
    """df as one struct column, so that its names cannot clash."""
    return df.select(F.struct(*df.columns).alias(name))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every document.

    taken = copies * size, copies from 0 to `most`. A null text has size 0; a null source is a source of its
    own, last in order. Documents of size 0 are taken as often as the whole part of what one word would be expected, and never
    sampled. Rows that are equal in source, doc_id (null ones likewise) and text are numbered and draw numbers of their own,
    so any part of them can be taken; which of them is of no account. Very long texts count whole. An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    rows = Mix(docs.select("doc_id", "source", "text"), weights, most, seed).rows_taken()
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """The mixed rows themselves: every row of docs as often as the mix takes it, with the columns of docs, whatever their names.

    Nulls, ties and long texts count as in mix(). Of rows that are equal in source, doc_id and text but not in other columns,
    those are taken that hash first in the part of the table they lie in.
    """
    return Mix(docs, weights, most, seed).docs_taken()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing": query}

ORACLE = {
    "op3_mixing": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(source, 'null') || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS who
  FROM documents),
d AS (SELECT *, CAST(length(bin(greatest(size, 1))) AS BIGINT) AS x, row_number() OVER (PARTITION BY who) - 1 AS nth FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, source_size * 3 AS cap, source_size * 3 / w::DOUBLE AS q, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY q, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY q, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM o),
lv AS (SELECT rest, w_rest FROM l WHERE cap * w_rest >= rest * w ORDER BY q, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, lv.rest::DOUBLE * w / lv.w_rest) AS target FROM l, lv),
c AS (SELECT source, x, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
cl AS (SELECT c.*, t.source_size, t.target, t.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
              (sum(x * words) OVER (PARTITION BY c.source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight
       FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
lx AS (SELECT source, max_by(rest / weight, x) AS c FROM cl WHERE weight > 0 AND rest * x <= 3 * weight GROUP BY source),
e AS (SELECT cl.source, cl.x, cl.words, source_size, target, least(3.0::DOUBLE, coalesce(lx.c, 0) * cl.x) AS e FROM cl LEFT JOIN lx ON cl.source IS NOT DISTINCT FROM lx.source),
f AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS f, target - (sum(CAST(floor(e) AS BIGINT) * words) OVER (PARTITION BY source))::DOUBLE AS gap FROM e),
k AS (SELECT *, u / (1 - u) / (f / (1 - f)) AS key FROM (
  SELECT d.*, f.f, f.gap, {TOLERANCE}::DOUBLE * f.target AS slack, (CAST('0x' || substr(md5('7:' || who || ':' || nth), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.x = f.x WHERE d.size > 0 AND f.f > 0)),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size, who, nth) AS upto FROM k),
g AS (SELECT source, max(gap) - coalesce(max(CASE WHEN upto <= gap THEN upto END), 0) AS missing, max(slack) AS slack FROM m GROUP BY source),
a AS (SELECT m.*, row_number() OVER (PARTITION BY m.source, x ORDER BY key, size, who, nth) AS n FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source WHERE upto > gap AND size <= missing),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x DESC, key, size, who, nth) AS step FROM a WHERE n <= {FILLERS}),
z AS (SELECT source, 0::BIGINT AS step, missing, slack, FALSE AS fits, NULL::VARCHAR AS who, NULL::BIGINT AS nth FROM g
  UNION ALL SELECT z.source, q.step, CASE WHEN z.missing > z.slack AND q.size <= z.missing THEN z.missing - q.size ELSE z.missing END, z.slack, z.missing > z.slack AND q.size <= z.missing, q.who, q.nth
  FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source AND q.step = z.step + 1),
y AS (SELECT who, nth FROM m WHERE upto <= gap UNION ALL SELECT who, nth FROM z WHERE fits)
SELECT d.doc_id, d.size, f.source_size, f.target, CAST((whole + CASE WHEN y.who IS NULL THEN 0 ELSE 1 END) * size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN y.who IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies, d.source
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.x = f.x LEFT JOIN y ON d.who = y.who AND d.nth = y.nth
"""
}
