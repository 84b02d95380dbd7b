"""The prefix trie of conversations, built depth by depth and rolled up again.

A node is a distinct sequence of first turns. At each depth the live conversations are grouped by (node, next turn); a group is a child,
named by its smallest conv_id. Turns are compared by SHA-256, so no text is shuffled. Three things keep the work even:
* conversations that are equal from end to end are one class with a weight from the start, so thousands of copies are one row;
* counts and minima are partial aggregates, and going down is an equi-join on written tables, which is split where a group is large;
* a class that is alone in its node leaves the loop: the rest of it is a chain whose numbers follow from running sums.
So there are as many rounds as the longest sequence of turns that two different conversations share. The way back up joins
each depth's nodes with the sums of their children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, cut_narrow
from .common import WORD, crc32_sql, positions, table

#: Turns that a rebuilt conversation may take from another one, and the distance of conversations that give some.
MOST_BORROWED, STRIDE = 3, 20
#: Identifiers in a piece of text on its way to a digest.
PIECE = 512


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, words, after (words of this turn and all later ones) of every turn: by turn, null first; equal
    turns by the digest of role and text. Null roles and texts are empty. Rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = positions(cut_narrow(own, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], running=["words"])
    return placed.select("conv_id", (F.col("p_pos") + 1).alias("pos"), "digest", "words", (F.col("p_all_words") - F.col("p_sum_words") + F.col("words")).alias("after"))


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, out of ones that do not: (conv_id, len) and their turns. c takes the first h turns of c - c % STRIDE
    (all if fewer, none if there is no such conversation), h = crc32(c) % 4, and goes on with its own turns after its first h."""
    head = F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST_BORROWED, F.struct("pos", "digest", "words"))))
    whole = F.max(F.struct(-F.col("pos"), "after"))["after"]
    convs = cut(turns.groupBy("conv_id").agg(head.alias("head"), F.count("*").alias("total"), whole.alias("all")), "heads")
    giver = convs.select(F.col("conv_id").alias("src"), F.col("head").alias("given"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    met = convs.withColumn("h", h.cast("int")).withColumn("src", F.col("conv_id") - F.col("conv_id") % STRIDE).join(giver, "src", "left")
    summed = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, t: x + t["words"])
    taken = F.coalesce(F.filter("given", lambda t: t["pos"] <= F.col("h")), F.filter("head", lambda t: F.lit(False)))
    left = F.col("all") - summed(F.filter("head", lambda t: t["pos"] <= F.col("h")))
    plan = met.select("conv_id", "h", taken.alias("taken"), left.alias("left"), (F.size(taken) + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("len"))
    plan = cut(plan, "plans")
    first = plan.select("conv_id", "taken", "left", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.pos").alias("pos"), F.col("t.digest").alias("digest"), F.col("t.words").alias("words"),
        (summed(F.filter("taken", lambda o: o["pos"] >= F.col("t.pos"))) + F.col("left")).alias("after"),
    )
    rest = turns.join(plan.select("conv_id", "h", F.size("taken").alias("m")), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "words", "after")
    return plan.select("conv_id", F.col("len").cast("long").alias("len")), first.unionByName(rest)


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, rep): equal conversations share the smallest conv_id among them. Equality is that of length and of 120 bits,
    the exclusive sum of hashes of (place, turn)."""
    mix = F.sha2(F.concat(F.encode(F.concat(F.col("pos").cast("string"), F.lit(":")), "UTF-8"), F.col("digest")), 256)
    bits = [F.bit_xor(F.conv(F.substring(mix, at, 15), 16, 10).cast("long")).alias(f"x{at}") for at in (1, 16)]
    found = convs.join(turns.groupBy("conv_id").agg(*bits), "conv_id", "left").select("conv_id", "len", *[F.coalesce(f"x{at}", F.lit(0)).alias(f"x{at}") for at in (1, 16)])
    found = cut(found, "signatures")
    key = ["len", "x1", "x16"]
    least = found.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w"))
    return cut(found.join(least, key).select("conv_id", "rep", "w", "len"), "classes")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (rep, conv_id) in order -> (rep, lo, piece): runs of identifiers, comma-joined."""
    for batch in batches:
        out = []
        for rep, ids in batch.groupby("rep", sort=False)["conv_id"]:
            ids = ids.tolist()
            out += [(rep, ids[at], ",".join(map(str, ids[at : at + PIECE]))) for at in range(0, len(ids), PIECE)]
        yield pd.DataFrame(out, columns=["rep", "lo", "piece"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order -> (rep, digest), holding one piece and one hash state at a time."""
    now, state = None, None
    for batch in batches:
        out = []
        for rep, piece in zip(batch["rep"], batch["piece"], strict=True):
            if rep != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = rep, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["rep", "ends_sha256"])
    if state:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["rep", "ends_sha256"])


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): SHA-256 of the ascending decimal conv_ids of each class, comma-joined. A class of any size is cut into
    pieces where it lies; only those pass through one task, as a stream."""
    lone = members.where("w = 1").select("rep", F.sha2(F.encode(F.col("rep").cast("string"), "UTF-8"), 256).alias("ends_sha256"))
    dealt = members.where("w > 1").select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    pieces = cut(dealt.mapInPandas(_pieces, "rep long, lo long, piece string"), "pieces")
    ordered = pieces.repartition("rep").sortWithinPartitions("rep", "lo")
    return lone.unionByName(ordered.mapInPandas(_digests, "rep long, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, the root included.

    convs: conv_id, len, each once, conversations without turns among them; turns: conv_id, pos (from 1, gapless), digest, words, after. A node is
    named by the smallest conv_id that begins with it. Without any conversation there is no node.
    """
    turns = cut(turns, "rebuilt")
    members = classes(convs, turns)
    reps = members.where("conv_id = rep").select("rep", "w", "len")
    rows = cut(turns.join(reps, turns["conv_id"] == reps["rep"]).select("rep", "pos", "digest", "words", "after", "w", "len").sortWithinPartitions("pos"), "turns")
    root = F.min("rep").alias("node"), F.sum("w").alias("n"), F.count("*").alias("k")
    top = cut(reps.agg(*root).where("k > 0").select("node", F.lit(None).cast("long").alias("parent"), "n", "k", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("len")), "root")
    levels, singles, ends = [top], [], []
    live = reps.crossJoin(F.broadcast(top.select("node"))).select("rep", "node", "len")  # one row is broadcast
    for depth in count():
        ends.append(live.where(F.col("len") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("conv_id"), "rep"))
        here = cut(rows.where(F.col("pos") == depth + 1).join(live.select("rep", "node"), "rep"), "live")
        grown = here.groupBy("node", "digest").agg(
            F.min("rep").alias("child"), F.sum("w").alias("n"), F.count("*").alias("k"), F.max("words").alias("words"), F.max("after").alias("after"), F.max("len").alias("len")
        )
        grown = cut(grown, "children")
        levels.append(grown.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n", "k", "words", "after", "len"))
        singles.append(grown.where("k = 1").select(F.col("child").alias("rep"), F.lit(depth + 1).cast("long").alias("start")))
        shared = grown.where("k > 1").select(F.col("node").alias("p"), F.col("digest").alias("t"), "child")
        if shared.isEmpty():
            break
        live = here.join(shared, (F.col("node") == F.col("p")) & (F.col("digest") == F.col("t"))).select("rep", F.col("child").alias("node"), "len")
    alone, ended = _union(singles), _union(ends)
    alone = cut(alone, "singles")
    ended = ended.unionByName(alone.join(reps, "rep").select(F.col("len").alias("depth"), F.col("rep").alias("conv_id"), "rep"))
    chains = rows.join(alone, "rep").where("pos > start")
    chains = chains.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("w").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("after")).alias("saved_tokens"),
    )
    nodes = _rolled_up(levels).unionByName(chains).join(ended.join(member_digests(members), "rep").drop("rep"), ["conv_id", "depth"], "left")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for one in tables[1:]:
        out = out.unionByName(one)
    return out


def _rolled_up(levels: list[DataFrame]) -> DataFrame:
    """Nodes by depth, from the deepest up: each depth meets the sums of the depth below by its children's parent."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        here, single = levels[depth], (F.col("k") == 1) & F.lit(depth > 0)
        if below is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            here = here.join(below, F.col("node") == F.col("of"), "left").drop("of").na.fill(0, ["children", "leaves", "saved"])
        done = here.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(single, (F.col("len") > depth).cast("long")).otherwise(F.col("children")).alias("n_children"), F.when(single, 1).otherwise(F.greatest("leaves", F.lit(1))).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * F.when(single, F.col("after")).otherwise(F.col("words")) + F.when(single, 0).otherwise(F.col("saved"))).alias("saved_tokens"),
        )
        done = cut(done, "depth")
        out.append(done)
        below = done.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return _union(out)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are. Repeated rows are turns of their own, of one place each; very long
    texts and conversations are hashed and counted whole; other columns are not read; an empty table has no node."""
    turns = cut(turns_of(conversations), "places")
    return trie(turns.groupBy("conv_id").agg(F.count("*").alias("len")), turns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*branched(cut(turns_of(table(spark, sf_dir, "conversations")), "places")))


QUERIES = {"op12_conversation_trie": query}

ORACLE = {
    "op12_conversation_trie": f"""
WITH one AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS k, length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM one),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM hashed),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS src, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
rows_ AS (
  SELECT c.conv_id, 0 AS part, o.pos, k, words FROM conv c JOIN own o ON o.conv_id = c.src AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, k, words FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, k, words FROM rows_),
member AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM conv
  UNION ALL SELECT conv_id, depth, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM turns),
size AS (SELECT conv_id, max(depth) AS len FROM member GROUP BY 1),
node AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM member GROUP BY 1, 2),
way AS (SELECT x.depth, x.path, x.conv_id, x.n, x.words, m.depth AS up, m.path AS at_ FROM node x JOIN member m ON m.conv_id = x.conv_id AND m.depth <= x.depth),
kids AS (SELECT up AS depth, at_ AS path, count(*) AS n_children FROM way WHERE up = depth - 1 GROUP BY 1, 2),
sums AS (
  SELECT w.up AS depth, w.at_ AS path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((w.n - 1) * w.words) AS saved
  FROM way w LEFT JOIN kids k ON k.depth = w.depth AND k.path = w.path GROUP BY 1, 2),
ends AS (SELECT m.depth, m.path, string_agg(m.conv_id, ',' ORDER BY m.conv_id) AS ids FROM member m JOIN size s ON s.conv_id = m.conv_id AND s.len = m.depth GROUP BY 1, 2)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node x JOIN sums s ON s.depth = x.depth AND s.path = x.path LEFT JOIN kids k ON k.depth = x.depth AND k.path = x.path LEFT JOIN ends e ON e.depth = x.depth AND e.path = x.path
LEFT JOIN way w ON w.depth = x.depth AND w.path = x.path AND w.up = x.depth - 1 LEFT JOIN node p ON p.depth = w.up AND p.path = w.at_
"""
}
