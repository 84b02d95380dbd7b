"""URL filters: exact membership of host-and-path rules by a cascade of Bloom filters.

A rule is a key, host + path. A url has a few keys of its own: the last labels of its host, as
many as some rule has, joined to the first characters of its path, as many as some rule has.
The rules that fit a url are its keys that are listed. Level 0 of a cascade holds the listed
keys; level 1 the keys of the whole corpus that level 0 takes for listed and that are not; level 2
the listed keys that level 1 takes for such, and so on until nothing is left, so over the keys of
that corpus the cascade is exact. Level 0 lets about as many keys through as there are
listed ones and later levels an eighth of the rest, so all levels together have a few bits for each
listed key however large the corpus is. Urls are then judged by expressions alone, without a join.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut
from .common import table

#: The rules of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A filter of up to so many bits is a literal of the plan; a larger one is the one row of a broadcast table. A filter has a few bits for each listed key, and the
#: driver holds the listed keys themselves, so the filter is the smaller of the two however long the list.
PLAN_BITS = 1 << 22
MOST_LEVELS = 64
#: Share of keys that a later level takes wrongly. A half would need the fewest bits, but three times as many levels, each a pass over the keys left.
LATER_RATE = 0.125

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.col(url).substr(at + 3, F.length(F.col(url)))).otherwise("")


@dataclass
class Bloom:
    level: int
    bits: int
    hashes: int
    words: list[int]
    column: Column | None = None
    name: str = ""

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64) * 64)
        return bits, max(1, round(math.log2(1 / rate)))

    def places(self, key: Column) -> list[Column]:
        """Bit places by double hashing, another pair of hashes for each level."""
        first, second = F.xxhash64(F.lit(2 * self.level), key), F.xxhash64(F.lit(2 * self.level + 1), key)
        half = F.lit((1 << 31) - 1)
        return [F.pmod(first.bitwiseAND(half) + F.lit(i) * second.bitwiseAND(half), F.lit(self.bits)) for i in range(self.hashes)]

    def on(self, df: DataFrame) -> DataFrame:
        """df as has() needs it: beside the words, if they are too many for a literal."""
        if self.bits <= PLAN_BITS:
            return df
        self.column, name = F.col(self.name), self.name
        return df if name in df.columns else df.crossJoin(F.broadcast(df.sparkSession.range(1).select(self._literal().alias(name))))

    def _literal(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")

    def has(self, key: Column) -> Column:
        if self.column is None:  # one literal, folded into one array by the optimiser
            self.column = self._literal()
        found = F.lit(True)
        for place in self.places(key):
            found = found & (F.getbit(F.element_at(self.column, (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int")) == 1)
        return found

    def fill(self, keys: DataFrame) -> Bloom:
        """Sets the bits of a table (key). What comes back is the filter's words, whose number is its size."""
        place = F.explode(F.array(*self.places(F.col("key")))).alias("p")
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        for row in keys.select(place).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(bit).alias("b")).collect():
            self.words[row["w"]] = row["b"]
        return self


class Cascade:
    """Exact membership of listed keys over a universe of keys."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, listed: list[str], universe: DataFrame) -> Cascade:
        """listed: the keys; universe: a table (key), repeats allowed, of every key that will be asked for."""
        if not listed:
            return cls([])
        known = F.from_json(F.lit(json.dumps(sorted(set(listed)))), "array<string>")
        inside = universe.sparkSession.range(1).select(F.explode(known).alias("key"))
        size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
        here, n, levels = inside, len(set(listed)), []
        there = None
        for level in range(MOST_LEVELS):
            rate = min(0.5, n * math.sqrt(0.5) / size) if level == 0 else LATER_RATE
            bits, hashes = Bloom.shape(n, rate)
            bloom = Bloom(level, bits, hashes, [0] * (bits // 64), name=f"_words_{uuid.uuid4().hex}").fill(here)
            levels.append(bloom)
            if level == 0:
                other = bloom.on(universe).where(bloom.has(F.col("key"))).select("key").distinct().join(inside, "key", "left_anti")
            else:
                other = bloom.on(there).where(bloom.has(F.col("key")))
            other = cut(other.select("key"), "keys")
            n = other.count()
            if not n:
                break
            here, there = other, here
        else:
            raise RuntimeError(f"a cascade did not end in {MOST_LEVELS} levels")
        return cls(levels)

    def on(self, df: DataFrame) -> DataFrame:
        for bloom in self.levels:
            df = bloom.on(df)
        return df

    def has(self, key: Column) -> Column:
        """Passing an even last level means listed; the first level that a key fails at decides otherwise."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for bloom in reversed(self.levels):
            answer = F.when(bloom.has(key), answer).otherwise(F.lit(bloom.level % 2 == 1))
        return answer

    @property
    def bits(self) -> int:
        return sum(b.bits for b in self.levels)


def keys_of(rules, rows: DataFrame) -> DataFrame:
    """rows (page_id, host, path) with keys: one for each shape (labels, path length) that a rule has and the url is long enough for.
    Whatever the number of rules, a url has as many keys as they have shapes."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    cut_ = {f"s{labels}": F.substring_index("host", ".", -labels) for labels, _ in shapes}
    rows = rows.withColumns({"depth": F.when(F.length("host") > 0, F.size(F.split("host", r"\."))).otherwise(0), "long": F.length("path"), **cut_})
    found = [F.when((F.col("depth") >= labels) & (F.col("long") >= length), F.concat(F.col(f"s{labels}"), F.substring("path", 1, length) if length else F.lit(""))) for labels, length in shapes]
    keys = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return rows.select("page_id", "host", "path", keys.alias("keys"))


def _listed(cascade: Cascade, verdict: str) -> Column:
    """What a cascade lists of a url's keys. All of them go through one expression, so the plan grows with the levels and not with the rules."""
    found = F.filter("keys", lambda key: cascade.has(key))
    order = F.lit("a" if verdict == "block" else "b")
    return F.transform(found, lambda key: F.struct((-F.length(key)).alias("n"), key.alias("rule"), order.alias("o"), F.lit(verdict).alias("verdict")))


def judge(pages: DataFrame, rules=RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Of the rules that fit, the longest (host and path together) wins, of equally long ones the first by
    code point; a key listed both ways is blocked. A url that no rule fits, a null one or one
    without :// gets a null rule and the verdict of the block list's cascade, not listed: `otherwise`.
    Repeated rows and null page_ids give a row each; an empty table gives none; a very long url is read whole; other columns are
    not read, whatever their names.
    """
    rows = keys_of(rules, pages.select("page_id", host_of().alias("host"), path_of().alias("path")))
    universe = rows.select(F.explode("keys").alias("key"))
    fits, judged = [], rows
    for verdict in ("block", "allow"):
        cascade = Cascade.build([h + p for v, h, p in rules if v == verdict], universe)
        if cascade.levels:
            judged = cascade.on(judged)
            fits.append(_listed(cascade, verdict))
    best = F.array_min(F.concat(*fits)) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")
    out = judged.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": query}

ORACLE = {
    "op8_url_filter": """
WITH r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
s AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT s.n, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY s.n ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN f ON s.n = f.n AND f.k = 1
"""
}
