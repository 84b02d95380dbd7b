"""SimHash fingerprints linked within three bits by Golay-code fuzzy hashing.

The binary Golay code (23, 12) is perfect: every 23-bit word lies within three bits of exactly
one codeword, and the words at distance three lie within four bits of five more. Let near(x)
be the codewords within four bits of x (one or six) and home(x) the nearest one. If x and y
differ in at most one bit, home(x) is in near(y), so a table of homes probed with near() finds
every pair at distance one.

A 64-bit fingerprint is split into segments of 22, 21 and 21 bits, each filled up to 23 with
zeros. Three differing bits fall on the segments as (3,0,0), (2,1,0) or (1,1,1) at worst, so
* some pair of segments differs in at most one bit altogether: probe near x home and home x near;
* or every segment differs in one bit: probe near x near of the first pair.
That is 3 stored keys and at most 58 probes for a distinct fingerprint, all candidates are
verified inside the join, and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.shared import cut, cut_narrow, fresh, stored_bytes
from .common import table

SEED = 42
MAX_BITS = 3
#: A table of ids is broadcast up to this size on disk; a larger one meets the documents by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Words hashed at a time, so that a very long text needs no more memory than this many shingles.
STEP = 1 << 16

#: Width of each segment of a fingerprint, lowest bits first.
SEGMENTS = (22, 21, 21)
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0b101011100011

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every byte place, and for each of the 2048 remainders up to six error patterns of
    weight four or less, the lightest first and -1 where there is none."""
    places = np.zeros(23, dtype=np.int64)
    for i in range(23):
        rest = 1 << i
        for shift in range(i - 11, -1, -1):
            if rest >> (shift + 11) & 1:
                rest ^= GENERATOR << shift
        places[i] = rest
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= int(places[i])
            if filled[s] and patterns[s, 0] >= 0 and weight == 4 and bin(int(patterns[s, 0])).count("1") < 3:
                raise AssertionError("the code is not perfect")
            patterns[s, filled[s]] = sum(1 << i for i in bits)
            filled[s] += 1
    assert filled.min() >= 1 and filled.max() == 6
    return places, patterns


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of 23-bit words: (n, 6), and which are there.
    The first one is the nearest."""
    places, patterns = _syndromes()
    words = np.asarray(words, dtype=np.int64)
    rest = np.zeros(len(words), dtype=np.int64)
    for i in range(23):
        rest ^= np.where(words >> i & 1, places[i], 0)
    errors = patterns[rest]
    there = errors >= 0
    return (words[:, None] ^ np.where(there, errors, 0)) >> 11, there


def _near_by_segment(fingerprints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    bits, out = fingerprints.astype(np.uint64), []
    for width in SEGMENTS:
        out.append(near_codewords((bits & np.uint64((1 << width) - 1)).astype(np.int64)))
        bits = bits >> np.uint64(width)
    return out


_PAIRS = ((0, 1), (0, 2), (1, 2))


def stored_keys(fingerprints: np.ndarray) -> np.ndarray:
    """The three keys under which each fingerprint is stored."""
    near = _near_by_segment(fingerprints)
    return np.stack([(k << 24) | (near[a][0][:, 0] << 12) | near[b][0][:, 0] for k, (a, b) in enumerate(_PAIRS)], axis=1)


def probe_keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The keys that meet the stored keys of every fingerprint within three bits."""
    near, columns, there = _near_by_segment(fingerprints), [], []
    for k, (a, b) in enumerate(_PAIRS):
        (x, in_x), (y, in_y) = near[a], near[b]
        for i in range(6):
            for j in range(6):
                if k == 0 or i == 0 or j == 0:
                    columns.append((k << 24) | (x[:, i] << 12) | y[:, j])
                    there.append(in_x[:, i] & in_y[:, j])
    keys, mask = np.stack(columns, axis=1), np.stack(there, axis=1)
    return [row[m] for row, m in zip(keys, mask, strict=True)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().translate(_LOWERED).split()
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    n, ones, digest = len(words) - size + 1, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(list(stored_keys(batch.to_numpy(dtype=np.int64).view(np.uint64))))


def _probes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        bits = batch.to_numpy(dtype=np.int64).view(np.uint64)
        yield pd.Series([row for at in range(0, len(bits), 2048) for row in probe_keys(bits[at : at + 2048])], dtype=object)


def fingerprint_column(text: str = "text") -> Column:
    return F.pandas_udf(_fingerprints, "long")(F.col(text))


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b: the distinct pairs of distinct fingerprints that differ in three bits or fewer."""
    one = fingerprints.select(F.col(fp).alias("f"))
    stored = one.select(F.explode(F.pandas_udf(_stored, "array<long>")("f")).alias("k"), F.col("f").alias("a"))
    probes = one.select(F.explode(F.pandas_udf(_probes, "array<long>")("f")).alias("k"), F.col("f").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    # the planner takes neither for larger than the fingerprints' file and would broadcast all probes of a middling table
    return stored.join(probes.hint("merge"), (stored["k"] == probes["k"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for a table (doc_id, fp): root names the component by its smallest fingerprint,
    component_id is the smallest doc_id in it.

    Copies share a fingerprint and meet as one row here, by partial aggregation.
    """
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    roots = cut(components(cut(links(reps), "links")), "roots")
    linked = roots.withColumnRenamed("node", "fp")
    least = linked.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("fp", "root", "least")
    # a component without any doc_id has none as its smallest, so the root decides which case holds
    own = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least"))
    return reps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), own.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    A text without words, null texts among them, has fingerprint zero and links like any other.
    Repeated rows stay; a null doc_id takes part and counts as no id, so a component made of such
    rows alone has a null component_id. An empty table gives no rows; other columns are not read.
    """
    prints = cut_narrow(docs.select("doc_id", fingerprint_column("text").alias("fp")), "prints")
    # both sides are plain tables, so that a fingerprint which many copies share is split
    found = prints.join(cut(classes(prints), "classes"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id names their component: one of each group, with all columns of docs.

    Of rows that share the naming doc_id one stays; a component of rows without doc_id keeps one of them.
    Only such rows are compared with each other. The others go by an anti-join with the ids to drop, which are
    broadcast if their measured size allows, so that texts are not shuffled for a few copies.
    """
    fp, root, cid = fresh(docs, "_ls_fp", "_ls_root", "_ls_component")
    prints = cut_narrow(docs.select("doc_id", fingerprint_column("text").alias("fp")), "prints")
    found = cut(classes(prints), "classes")
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = cut(ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(cid)), "odd")
    is_row = F.col("doc_id").eqNullSafe(F.col(cid))
    others = prints.join(found, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias(cid))
    drop = cut(others.unionByName(odd.where(F.col(cid).isNotNull())).distinct(), "drop")
    named_rows = docs.where("doc_id is not null")
    kept = named_rows.join(F.broadcast(drop) if stored_bytes(drop) <= BROADCAST_BYTES else drop, F.col("doc_id") == F.col(cid), "left_anti")
    if odd.isEmpty():
        return kept
    again = docs.join(odd, is_row, "left_semi").withColumn(fp, fingerprint_column("text"))
    named = found.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(cid))
    again = again.join(named, fp).where(is_row).dropDuplicates([root])
    return kept.unionByName(again.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_dedup": query}
