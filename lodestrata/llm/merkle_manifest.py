"""A Merkle manifest of a table: one tree over the rows of each group, one tree over the groups, and an inclusion proof for every row.

Rows are dealt by ranges of (group, order), so each range is a run of consecutive positions. A task
walks its runs with a mountain-range stack: a node that completes the run of `fanout` siblings it belongs to carries
into their parent, as a digit carries in base `fanout`, and finished nodes are emitted as records. Nodes whose parent
reaches over the edge of a range stay as peaks; these few are merged in rounds of several levels,
each parent's descendants meeting by a shuffle on their common ancestor. The last run of a level may be short, even one node,
and is hashed as it is, without padding, so positions and counts alone say which nodes exist.

Proofs need no join for each level: rows meet in aligned blocks of at most BLOCK, a block works out the levels inside it, and the
levels above it are one short path for the whole block.

H is the lowercase hex SHA-256 of its inputs' hex texts put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, cut_narrow
from .common import crc32_sql, positions, table

FANOUT = 2
#: Leaves in a block and, as nodes of one level, in a step of the merge.
BLOCK = 4096
#: What a leaf hashes, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODE = "key string, level int, pos long, total long, digest string, edge boolean"


def H(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def counts(total: int, fanout: int) -> list[int]:
    """Nodes of each level, leaves first, one at the top."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def field(value: Column) -> Column:
    """A field without ambiguity: - if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, values)), "UTF-8"), 256)


class MountainRange:
    """The stack of one run of consecutive positions: pushes leaves in order, emits (level, pos, digest, edge) records.

    No more than fanout - 1 digests a level are held. An edge record is a peak whose parent needs nodes beyond the run.
    """

    def __init__(self, total: int, fanout: int):
        self.counts, self.fanout = counts(total, fanout), fanout
        self.open: list[list[str]] = [[] for _ in self.counts]
        self.first = [0] * len(self.counts)

    def push(self, pos: int, digest: str, level: int = 0) -> Iterator[tuple[int, int, str, bool]]:
        while True:
            if level == len(self.counts) - 1:
                yield level, pos, digest, False
                return
            place, run = pos % self.fanout, self.open[level]
            if place and not run:  # the run's first sibling lies in an earlier range
                yield level, pos, digest, True
                return
            if not run:
                self.first[level] = pos
            run.append(digest)
            if place < self.fanout - 1 and pos < self.counts[level] - 1:
                return
            digest = H(*run)
            for k, d in enumerate(run):
                yield level, self.first[level] + k, d, False
            run.clear()
            level, pos = level + 1, pos // self.fanout

    def close(self) -> Iterator[tuple[int, int, str, bool]]:
        for level, run in enumerate(self.open):
            for k, d in enumerate(run):
                yield level, self.first[level] + k, d, True


def _walk(fanout: int, least: int):
    """mapInPandas: rows (p_part, key, p_pos, p_total, digest) in order -> node records of level `least` or higher, roots and all edges."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack, key = None, None, None
        for batch in batches:
            out = []
            for part, k, pos, total, digest in zip(batch["p_part"], batch["key"], batch["p_pos"], batch["p_total"], batch["digest"], strict=True):
                if (part, k) != now:
                    if stack:
                        out += [(key, *r, total_) for r in stack.close()]
                    now, key, total_, stack = (part, k), k, total, MountainRange(total, fanout)
                out += [(k, *r, total) for r in stack.push(pos, digest) if r[0] >= least or r[3] or r[0] == len(stack.counts) - 1]
            yield _frame(out)
        if stack:
            yield _frame([(key, *r, total_) for r in stack.close()])

    return of


def _frame(records: list[tuple]) -> pd.DataFrame:
    rows = [(key, level, pos, total, digest, edge) for key, level, pos, digest, edge, total in records]
    return pd.DataFrame(rows, columns=["key", "level", "pos", "total", "digest", "edge"])


def _merge(fanout: int, target: int, least: int):
    """applyInPandas: the peaks below one node of level `target` (or of the top, if that is lower) -> nodes from them up to it, of
    level `least` or higher, and roots."""

    def of(peaks: pd.DataFrame) -> pd.DataFrame:
        key, total = peaks["key"].iloc[0], int(peaks["total"].iloc[0])
        have = counts(total, fanout)
        levels: dict[int, dict[int, str]] = {}
        for level, pos, digest in zip(peaks["level"], peaks["pos"], peaks["digest"], strict=True):
            levels.setdefault(int(level), {})[int(pos)] = digest
        top, out = min(target, len(have) - 1), []
        for level in range(min(levels), top):
            nodes = levels.get(level, {})
            out += [(key, level, pos, d, False, total) for pos, d in nodes.items() if level >= least]
            for parent in {pos // fanout for pos in nodes}:
                run = range(parent * fanout, min((parent + 1) * fanout, have[level]))
                levels.setdefault(level + 1, {})[parent] = H(*[nodes[pos] for pos in run])
        out += [(key, top, pos, d, top < len(have) - 1, total) for pos, d in levels[top].items()]
        return _frame(out)

    return of


def _step(fanout: int) -> int:
    """Levels that a block or a round of the merge spans."""
    step = 1
    while fanout ** (step + 1) <= BLOCK:
        step += 1
    return step


def nodes(placed: DataFrame, fanout: int = FANOUT, least: int = 0) -> DataFrame:
    """(key, level, pos, total, digest) of all nodes of level `least` or higher, and of every root whatever its level, for leaves
    placed by positions(): key, digest, p_*. Level 0 are the leaves. An empty table has no nodes.
    """
    rows = placed.select("p_part", "key", "p_pos", "p_total", "digest").repartition("p_part", "key").sortWithinPartitions("p_part", "key", "p_pos")
    made = cut(rows.mapInPandas(_walk(fanout, least), _NODE), "nodes")
    most = placed.agg(F.max("p_total")).first()[0] or 0
    done, peaks, step = made.where(~F.col("edge")), made.where("edge"), _step(fanout)
    height = len(counts(most, fanout)) - 1
    for target in range(step, height + step, step):
        # a node of level t covers fanout ** t leaves; the tops of smaller trees stand at position 0
        ancestor = F.floor(F.col("pos") / F.pow(F.lit(float(fanout)), F.lit(target) - F.col("level"))).cast("long")
        low = peaks.where(F.col("level") < target)
        merged = cut(low.groupBy("key", ancestor.alias("at")).applyInPandas(_merge(fanout, target, least), _NODE), "merged")
        done, peaks = done.unionByName(merged.where(~F.col("edge"))), merged.where("edge").unionByName(peaks.where(F.col("level") >= target))
    return done.select("key", "level", "pos", "total", "digest")


def roots(found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(key, total, digest) of the trees among nodes()."""
    top = F.max(F.struct("level", "total", "digest")).alias("t")
    return found.where("pos = 0").groupBy("key").agg(top).select("key", "t.total", "t.digest")


def _above(found: DataFrame, trees: DataFrame, fanout: int, step: int) -> DataFrame:
    """(key, block, above): the siblings left and right of a block's ancestors, one entry for each level that has any."""
    size = fanout**step
    blocks = trees.select("key", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size))).alias("block"))
    here = found.where(F.col("level") >= step)
    # up from its own level, each block asks for the other nodes of the run that its ancestor stands in
    height = F.ceil(F.log(F.col("total").cast("double")) / F.log(F.lit(float(fanout)))).cast("int") + 1
    asks = blocks.where(F.col("total") > size).withColumn("level", F.explode(F.sequence(F.lit(step), F.greatest(height, F.lit(step)))))
    asks = asks.withColumn("own", F.floor(F.col("block") / F.pow(F.lit(float(fanout)), F.col("level") - step)).cast("long"))
    asks = asks.withColumn("pos", F.explode(F.sequence((F.col("own") - F.col("own") % fanout), (F.col("own") - F.col("own") % fanout + fanout - 1)))).where("pos <> own")
    met = asks.join(here.select("key", "level", "pos", "digest"), ["key", "level", "pos"])
    beside = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("pos", "digest")))), lambda s: s["digest"]), "")
    runs = met.groupBy("key", "block", "level").agg(beside(F.col("pos") < F.col("own")).alias("left"), beside(F.col("pos") > F.col("own")).alias("right"))
    return runs.groupBy("key", "block").agg(F.collect_list(F.struct("level", "left", "right")).alias("above"))


def _prove(fanout: int, step: int, carried: list[str], with_siblings: bool):
    """cogrouped applyInPandas: the rows of one block and what is above it, in one row -> a proof a row."""

    def pairs(found) -> list[tuple[str, str]]:
        return [(a["left"], a["right"]) for a in found] if found is not None else []

    def of(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_pos", ignore_index=True)
        have, up = counts(int(rows["p_total"].iloc[0]), fanout), upper.iloc[0]
        levels, inner = [list(rows["digest"])], min(step, len(have) - 1)
        while len(levels) <= inner:
            last = levels[-1]
            levels.append([H(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
        siblings = {} if up["above"] is None else {a["level"]: (a["left"], a["right"]) for a in up["above"]}
        shared = [siblings.get(level, ("", "")) for level in range(inner, len(have) - 1)] + pairs(up["beyond"])
        tail, out = "".join(a + b for a, b in shared), []
        for k, (digest, other) in enumerate(zip(rows["digest"], rows["tampered"], strict=True)):
            path, at = [], k
            for level in range(inner):
                run = at - at % fanout
                path.append(("".join(levels[level][run:at]), "".join(levels[level][at + 1 : run + fanout])))
                at //= fanout
            x = digest if other is None else other
            for left, right in path + shared:
                x = H(left, x, right)
            both = [{"left": a, "right": b} for a, b in path + shared] if with_siblings else None
            out.append((up["subroot"], up["root"], H("".join(a + b for a, b in path), tail), x, both))
        return pd.concat([rows[carried], pd.DataFrame(out, columns=["subroot", "root", "proof_sha256", "folded_root", "siblings"])], axis=1)

    return of


_SIBLINGS = "array<struct<left: string, right: string>>"


def proofs(placed: DataFrame, found: DataFrame, carried: list[str], tops: DataFrame | None = None, fanout: int = FANOUT, with_siblings: bool = False) -> DataFrame:
    """The carried columns of every placed leaf (key, digest, tampered, p_*) with subroot, root, proof_sha256, folded_root and, if asked for,
    siblings: left and right ones as one text each, level by level.

    found: nodes() of these leaves, of the level of blocks at least. tops: (key, beyond, root) continues the proofs above a tree's own root by the siblings
    beyond it. folded_root starts from tampered where that is not null. A task holds one block at a time.
    """
    step = _step(fanout)
    trees, size = roots(found, fanout), fanout**step
    blocks = trees.select("key", F.col("digest").alias("subroot"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size))).alias("block"))
    upper = blocks.join(_above(found, trees, fanout, step), ["key", "block"], "left")
    upper = upper.join(tops, "key") if tops is not None else upper.withColumns({"beyond": F.array().cast(_SIBLINGS.replace(": ", ":")), "root": F.col("subroot")})
    rows = placed.select("key", "p_pos", "p_total", "digest", "tampered", *[F.col(c).alias(f"c_{c}") for c in carried], F.floor(F.col("p_pos") / size).alias("block"))
    kept = [f"c_{c}" for c in carried]
    kind = ", ".join([*[f"{k} {placed.schema[c].dataType.simpleString()}" for k, c in zip(kept, carried, strict=True)], "subroot string, root string, proof_sha256 string, folded_root string", f"siblings {_SIBLINGS}"])
    made = rows.groupBy("key", "block").cogroup(upper.groupBy("key", "block")).applyInPandas(_prove(fanout, step, kept, with_siblings), kind)
    return made.withColumnsRenamed(dict(zip(kept, carried, strict=True))).drop(*[] if with_siblings else ["siblings"])


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None, with_siblings: bool = False) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root (and siblings) of every row; folded_root is folded from the leaf hash
    `tampered` where that is not null, else from the leaf.

    Rows of a lang stand by doc_id, null first, then by leaf; langs stand by their UTF-8 bytes, null first, and a null lang is a group like any
    other. Repeated rows are leaves of their own. Null fields and empty ones hash differently. Texts of any length are hashed whole where
    they lie and travel no further. Other columns are not read. An empty table has no rows and no root.
    """
    hashed = docs.select(
        "doc_id", "lang", leaf(*[F.col(c) for c in FIELDS]).alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
        F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang")).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    # texts are read once: dealing by ranges samples its input before it deals it
    leaves = cut_narrow(hashed, "leaves")
    placed = cut(positions(leaves, "key", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")]), "placed")
    found = cut(nodes(placed, fanout, _step(fanout)), "upper")
    trees = roots(found, fanout).select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest", F.lit(None).cast("string").alias("tampered"))
    above = cut(positions(trees, "key", [F.col("tree")], name="trees"), "trees")
    tops = proofs(above, nodes(above, fanout, _step(fanout)), ["tree"], fanout=fanout, with_siblings=True)
    tops = cut(tops.select(F.col("tree").alias("key"), "root", F.col("siblings").alias("beyond")), "tops")
    made = proofs(placed, found, ["doc_id", "lang", "digest"], tops, fanout, with_siblings)
    return made.withColumnRenamed("digest", "leaf")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*more.values()))
    made = manifest(docs, tampered=changed).drop("lang")
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_merkle_manifest": query}

_FIELD_SQL = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in FIELDS) + ")"
_TREE_SQL = """SELECT {keys}, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {tree} WHERE n > 1 GROUP BY {keys}, level, pos // 2"""

ORACLE = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN changed ELSE leaf END AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM (
    SELECT doc_id, lang, {_LEAF_SQL} AS leaf, {_LEAF_SQL.replace("CAST(n_chars AS", "CAST(n_chars + 1 AS")} AS changed, coalesce('=' || lang, '-') AS k FROM documents)),
tree(k, level, pos, h, n) AS (
  SELECT k, 0, spot, leaf, count(*) OVER (PARTITION BY k) FROM d UNION ALL {_TREE_SQL.format(keys="k", tree="tree")}),
tops AS (SELECT k, h, level, row_number() OVER (ORDER BY encode(k)) - 1 AS spot FROM tree WHERE n = 1),
upper(level, pos, h, n) AS (
  SELECT 0, spot, h, count(*) OVER () FROM tops UNION ALL {_TREE_SQL.format(keys="1", tree="upper").replace("SELECT 1, level", "SELECT level").replace("GROUP BY 1, level", "GROUP BY level")}),
crown AS (SELECT h, level FROM upper WHERE n = 1),
low AS (
  SELECT doc_id, leaf, k, 0 AS level, spot AS pos, start AS x, '' AS proof FROM d
  UNION ALL
  SELECT doc_id, leaf, low.k, low.level + 1, low.pos // 2, sha256(CASE WHEN low.pos % 2 = 1 THEN s.h ELSE '' END || x || CASE WHEN low.pos % 2 = 0 THEN coalesce(s.h, '') ELSE '' END), proof || coalesce(s.h, '')
  FROM low JOIN tops ON tops.k = low.k AND low.level < tops.level LEFT JOIN tree s ON s.k = low.k AND s.level = low.level AND s.pos = xor(low.pos, 1)),
high AS (
  SELECT doc_id, leaf, tops.h AS subroot, 0 AS level, tops.spot AS pos, x, proof FROM low JOIN tops ON tops.k = low.k AND tops.level = low.level
  UNION ALL
  SELECT doc_id, leaf, subroot, high.level + 1, high.pos // 2, sha256(CASE WHEN high.pos % 2 = 1 THEN s.h ELSE '' END || x || CASE WHEN high.pos % 2 = 0 THEN coalesce(s.h, '') ELSE '' END), proof || coalesce(s.h, '')
  FROM high JOIN crown ON high.level < crown.level LEFT JOIN upper s ON s.level = high.level AND s.pos = xor(high.pos, 1))
SELECT doc_id, leaf, subroot, crown.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = crown.h AS verified
FROM high JOIN crown ON high.level = crown.level
"""
}
