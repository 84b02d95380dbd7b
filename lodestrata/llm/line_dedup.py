"""Repeated and nearly repeated lines by a segment-partition edit join.

Two lines are near copies if their similarity, 1 - edits / length of the longer one, is at least 0.8, with EDITS
edits at most: one edit from 5 characters on, two from 10 on, none below.

Two lines within m edits share one of m + 1 segments of the shorter one, at a place in the longer one that
differs little. Every distinct line is split into m + 1 even segments, which are stored by number and line
length; it probes the segments of lines that are up to m characters shorter with those of its substrings that the
place of the segment and the difference in length allow. Keys are hashes: first only keys and line hashes are
shuffled, to find the few lines that meet at all; only those lines are fetched, and every pair is verified inside the
join. A pair counts under the first key that its lines share, so that links are summed line by line and pairs are
neither written nor made distinct. A key that many lines share is dealt out by pairs of blocks.

The check strips what both lines share at either end, found by halving steps, and runs a banded
bit-parallel edit distance over the rest: the differences of neighbouring cells of a band of
2 * EDITS + 1 diagonals are bits of two integers, and a column takes a handful of integer
operations. It stops where the diagonal that ends in the answer exceeds EDITS.

Hashes of 64 bits only bring candidates together; lines and texts are told apart by 128 bits.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, cut_narrow, fresh, stored_bytes
from .common import quoted, table

EDITS = 2
#: Characters of the longer line for each edit that is allowed: a similarity of 0.8.
PER_EDIT = 5
#: Rows of one key that meet in one place; more are dealt out by pairs of blocks.
BLOCK = 1024
#: A table of line hashes is broadcast up to this size on disk; a larger one meets its lines by a shuffle.
BROADCAST_BYTES = 16 << 20


def _bind(value: Column, use) -> Column:
    """use(value) with the value worked out once: a transform of one element."""
    return F.transform(F.array(value), use)[0]


def banded_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """Edit distance of two strings if it is at most `most`, else some larger number.

    Bit k of the band stands for row j + k - most of column j. vp and vn hold where a cell is one more or
    one less than the cell above it, d0 where it equals the cell one up and one left.
    """
    width = 2 * most + 1
    mask = (1 << width) - 1
    blank = F.array_repeat(F.lit(""), most)  # no row of the table: an empty string equals no character
    start = F.struct(F.lit(mask & ~((1 << most) - 1)).cast("int").alias("vp"), F.lit(0).alias("vn"))

    def walk(p: Column) -> Column:
        def column(s: Column, j: Column) -> Column:
            same = F.lit(0)
            for k in range(width):
                same = same.bitwiseOR(F.when(F.get(p["a"], j + (k - 1)) == F.get(p["b"], j - 1), F.lit(1 << k)).otherwise(F.lit(0)))
            step = _bind(same, lambda x: _bind(_d0(x, s, mask), lambda d0: _next(d0, s, p["diagonal"], most, mask)))
            return F.when(s["score"] > most, s).otherwise(step)

        # the answer lies on the diagonal m - n; cells never decrease along it
        first = F.struct(start["vp"].alias("vp"), start["vn"].alias("vn"), F.greatest(p["diagonal"], F.lit(0)).alias("score"))
        far = F.abs(p["diagonal"]) > most
        return F.when(far, F.lit(most + 1)).when(p["n"] == 0, p["m"]).when(p["m"] == 0, p["n"]).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(p["n"], F.lit(1))), first, column)["score"]
        )

    chars = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    parts = F.struct(
        F.concat(blank, chars(a), blank).alias("a"), chars(b).alias("b"), F.length(a).alias("m"), F.length(b).alias("n"), (F.length(a) - F.length(b)).alias("diagonal")
    )
    return _bind(parts, walk)


def _d0(x: Column, s: Column, mask: int) -> Column:
    vp, vn = s["vp"], s["vn"]
    return (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))


def _next(d0: Column, s: Column, diagonal: Column, most: int, mask: int) -> Column:
    vp, vn = s["vp"], s["vn"]
    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask))
    hn = d0.bitwiseAND(vp)
    down = F.shiftright(d0, 1)
    return F.struct(
        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
        down.bitwiseAND(hp).alias("vn"),
        (s["score"] + 1 - F.getbit(d0, diagonal + most).cast("int")).alias("score"),
    )


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of what two strings begin with alike, by steps of falling powers of two."""

    def grow(least: Column) -> Column:
        steps = F.sequence(F.floor(F.log2(F.greatest(least, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

        def longer(at: Column, k: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), k)
            fits = (at + step <= least) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
            return F.when(fits, at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), longer)

    return _bind(F.least(F.length(a), F.length(b)), grow)


def within(a: Column, b: Column, most: int = EDITS, allowed: Column | None = None) -> Column:
    """Whether two strings are at most `most` (and `allowed`) edits apart: what they share at either end is stripped first."""
    limit = F.lit(most) if allowed is None else allowed

    def core(c: Column) -> Column:
        rest = lambda q: F.struct(F.substring(c["x"], F.lit(1), F.length(c["x"]) - q).alias("x"), F.substring(c["y"], F.lit(1), F.length(c["y"]) - q).alias("y"))
        suffix = _bind(F.struct(F.reverse(c["x"]).alias("x"), F.reverse(c["y"]).alias("y")), lambda v: _common_prefix(v["x"], v["y"]))
        return _bind(_bind(suffix, rest), lambda z: banded_distance(z["x"], z["y"], most) <= limit)

    tail = lambda p: F.struct(F.substring(a, p + 1, F.length(a)).alias("x"), F.substring(b, p + 1, F.length(b)).alias("y"))
    answer = _bind(_bind(_common_prefix(a, b), tail), core)
    return F.when(F.abs(F.length(a) - F.length(b)) > limit, F.lit(False)).otherwise(answer)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(line: Column) -> list[Column]:
    """How often each of 24 letters occurs, modulo 256, eight to a long integer."""
    counts = [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(255)) for c in _LETTERS[:24]]
    packed = []
    for at in range(0, 24, 8):
        word = F.lit(0).cast("long")
        for k in range(8):
            word = word.bitwiseOR(F.shiftleft(counts[at + k], 8 * k))
        packed.append(word)
    return packed


def count_difference(a: list[Column], b: list[Column]) -> Column:
    """A lower bound of the sum of differences of letter counts; an edit changes that sum by two at most."""
    total = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        for k in range(8):
            d = F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * k).bitwiseAND(F.lit(255))
            total = total + F.least(F.abs(d), 256 - F.abs(d))
    return total


def allowed_edits(longer: Column, most: int = EDITS) -> Column:
    """Edits that two lines may differ by, of which the longer one has so many characters."""
    return F.least(F.lit(most), F.floor(longer / PER_EDIT).cast("int"))


def _probes(m: int) -> list[tuple[int, int, int]]:
    """(d, i, s): a line probes segment i of lines that are d characters shorter at s characters from its place.

    Of m edits around an intact segment i, i at most lie before it and m - i at most behind it where the others are taken
    by i + 1 .. m, so s lies in [-i..i] and in [d - (m - i)..d + (m - i)].
    """
    return [(d, i, s) for d in range(m + 1) for i in range(m + 1) for s in range(max(-i, d - (m - i)), min(i, d + (m - i)) + 1)]


def _segment(n: Column, m: int, i: int) -> tuple[Column, Column]:
    """Place (from 0) and size of segment i of a line of n characters: m + 1 segments, the last n mod (m + 1) one character longer."""
    parts = m + 1
    r = (n % parts).cast("int")
    q = ((n - r) / parts).cast("int")
    return q * i + F.greatest(r - (parts - i), F.lit(0)), q + F.when(r >= parts - i, 1).otherwise(0)


def _code(m: int, d: int, i: int, s: int) -> int:
    return ((m * 16 + i) * 16 + d) * 16 + s + 8


def _stored(code: Column) -> Column:
    """Whether a line's own segment (d and s are 0) was probed."""
    return code.bitwiseAND(F.lit(255)) == 8


def segment_keys(lines: DataFrame, most: int = EDITS) -> DataFrame:
    """(lid, key, code) for a table (lid, line, n): the keys under which a line is stored, which are its own probes
    for lines of its length, and its further probes. code tells the scheme, the segment, the difference in length and the shift of a probe.

    Scheme m is for pairs that may differ by m edits, so the shorter line has (PER_EDIT - 1) * m characters at least, and every
    segment one at least. Places are columns of their own and keys plain expressions of them, so that all of it is compiled code.
    """
    out = None
    for m in range(1, most + 1):
        own = lines.where(F.col("n") >= (PER_EDIT - 1) * m)
        if m < most:
            own = own.where(F.col("n") < PER_EDIT * (m + 1))
        cuts = {(d, i): _segment(F.col("n") - d, m, i) for d in range(m + 1) for i in range(m + 1)}
        places = [c.alias(f"{k}{d}_{i}") for (d, i), both in cuts.items() for k, c in zip("pz", both, strict=True)]
        # four bytes for every character, so that a segment is cut out without walking through the line
        placed = own.select("lid", "n", F.encode("line", "UTF-32").alias("u"), *places)
        found = []
        for d, i, s in _probes(m):
            key = F.xxhash64(F.lit(m * 8 + i), F.col("n") - d, F.substring("u", (F.col(f"p{d}_{i}") + s) * 4 + 1, F.col(f"z{d}_{i}") * 4))
            found.append(F.struct(key.alias("key"), F.lit(_code(m, d, i, s)).alias("code")))
        keys = placed.select("lid", F.explode(F.array(*found)).alias("k")).select("lid", "k.key", "k.code")
        out = keys if out is None else out.unionAll(keys)
    return out


def first_shared(x: Column, y: Column, n: Column, more: Column, m_of: Column, most: int = EDITS) -> Column:
    """The code of the first probe of y that meets x: x has n characters, y has `more` more, and they may differ by m_of edits."""
    code = None
    for m in range(1, most + 1):
        for d, i, s in _probes(m):
            place, size = _segment(n, m, i)
            here = (m_of == m) & (more == d) & (F.substring(x, place + 1, size) == F.substring(y, place + s + 1, size))
            code = F.when(here, _code(m, d, i, s)) if code is None else code.when(here, _code(m, d, i, s))
    return code


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, th (md5 of the text), pos, line."""
    # the text's md5 is worked out before lines are laid out, once for each text
    texts = docs.where("text is not null").select("doc_id", _md5("text").alias("th"), F.split("text", "\n").alias("lines"))
    return texts.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))


def _md5(name: str) -> Column:
    return F.unhex(F.md5(F.col(name)))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """line, n (its length), lid (a hash to find candidates by), tag (its md5), owner (smallest doc_id), occurrences; empty lines are left out."""
    lines = exploded(docs).where("line <> ''").select("doc_id", "line")
    found = lines.groupBy("line").agg(F.min("doc_id").alias("owner"), F.count("*").alias("occurrences"))
    return found.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("lid"), _md5("line").alias("tag"), "owner", "occurrences")


def _if_small(df: DataFrame) -> DataFrame:
    """A table that cut() returned, marked for broadcast if its measured size allows."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df.hint("merge")


def near_links(lines: DataFrame, most: int = EDITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, and of either line x_ and y_ what is to be carried): each pair of near copies among distinct lines (lid, line, n) once."""
    # dealt out once: counting and joining read all columns, so they share one shuffle
    keys = segment_keys(lines, most).repartition("key")
    # keys under which a stored line and another one meet
    meets = keys.groupBy("key").agg(F.min("lid").alias("least"), F.max("lid").alias("most"), F.max(_stored(F.col("code"))).alias("any"), F.count("*").alias("n_rows"))
    meets = meets.where(F.col("any") & (F.col("least") != F.col("most"))).select("key", F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("nb"))
    few = cut_narrow(keys.join(meets, "key"), "meeting")
    own = lines.select("lid", "line", "n", *carry).join(_if_small(cut(few.select("lid").distinct(), "lids")), "lid", "left_semi")
    texts = cut_narrow(own.select("*", *[c.alias(f"c{k}") for k, c in enumerate(letter_counts(F.col("line")))]), "texts")
    full = few.join(texts, "lid").withColumn("blk", F.pmod("lid", "nb").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    columns = ["line", "n", "code", "c0", "c1", "c2", *carry]
    side = lambda df, lid, x, i, j: df.select("key", F.col("lid").alias(lid), F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    a, b = side(full.where(_stored(F.col("code"))), "a", "x", "blk", "p"), side(full, "b", "y", "p", "blk")
    alike = count_difference(*[[F.col(f"{x}_c{k}") for k in range(3)] for x in "xy"]) <= 2 * most
    more = F.col("y_n") - F.col("x_n")
    allowed = allowed_edits(F.col("y_n"), most)
    # the stored line is the shorter one; of lines of one length the hash decides
    possible = ((more > 0) | ((more == 0) & (F.col("a") < F.col("b")))) & (more <= allowed) & alike
    first = first_shared(F.col("x_line"), F.col("y_line"), F.col("x_n"), more, allowed, most) == F.col("y_code")
    same = (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"])
    pairs = a.join(b, same & possible & first & within(F.col("x_line"), F.col("y_line"), most, allowed))
    return pairs.select("a", "b", *[f"{x}_{c}" for x in "xy" for c in carry])


def decisions(docs: DataFrame, most: int = EDITS) -> DataFrame:
    """tag, owner, n_links, dropped for every line that occurs more than once or links to another one.

    A line is dropped if it links to a line that comes before it: one with a smaller owner (none is last),
    of equal owners the smaller md5.
    """
    lines = cut(distinct_lines(docs), "lines")
    mine = F.struct(F.col("owner").isNull().alias("no"), F.col("owner").alias("owner"), F.col("tag").alias("tag"))
    pairs = near_links(lines.withColumn("o", mine), most, ("o",))
    ends = F.explode(F.array(F.struct(F.col("x_o.tag").alias("tag"), F.col("y_o").alias("o")), F.struct(F.col("y_o.tag").alias("tag"), F.col("x_o").alias("o")))).alias("e")
    first = cut(pairs.select(ends).groupBy(F.col("e.tag").alias("of")).agg(F.min("e.o").alias("before"), F.count("*").alias("n_links")), "near")
    facts = lines.select("tag", "owner", "occurrences").join(_if_small(first), F.col("tag") == F.col("of"), "left")
    facts = facts.where("occurrences > 1 or of is not null")
    out = facts.select("tag", "owner", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("before") < mine, F.lit(False)).alias("dropped"))
    return cut_narrow(out, "decisions")


def removed_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, th, exact and near (places of lines to remove), n_links for the documents with such lines.

    The owner keeps a line at its first place; every other occurrence goes as a copy, and a dropped
    line goes everywhere.
    """
    where = exploded(docs).where("line <> ''").select("doc_id", "th", "pos", _md5("line").alias("tag"))
    named = where.join(_if_small(found), "tag")
    per_line = named.groupBy("doc_id", "th", "tag", "owner", "dropped", "n_links").agg(F.min("pos").alias("first"), F.collect_set("pos").alias("places"))
    own = F.col("doc_id").eqNullSafe(F.col("owner"))
    exact = F.when(own, F.filter("places", lambda p: p != F.col("first"))).otherwise(F.col("places"))
    none = F.array().cast("array<int>")
    per_line = per_line.withColumn("near", F.when(F.col("dropped"), F.col("places")).otherwise(none)).withColumn("exact", F.when(F.col("dropped"), none).otherwise(exact))
    per_doc = per_line.groupBy("doc_id", "th").agg(
        F.sort_array(F.flatten(F.collect_list("exact"))).alias("exact"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"), F.sum("n_links").alias("n_links")
    )
    return per_doc


def dedup_lines(docs: DataFrame, most: int = EDITS) -> DataFrame:
    """docs with each line kept in one place: the text without its removed lines, all other columns as they are, whatever their names.

    Lines end at line feeds. Exact copies are dropped whatever their length, near copies by similarity (see above).
    Empty lines and null or empty texts stay; a text is read whole however long it or its lines are. Rows that share a doc_id, or
    have none, count as one document: each keeps what that document owns. A document may end up empty. An empty table
    gives no rows.
    """
    found = decisions(docs, most)
    th, did, gone = fresh(docs, "_ls_th", "_ls_doc", "_ls_gone")
    marks = cut(removed_lines(docs, found).select(F.col("doc_id").alias(did), F.col("th").alias(th), F.array_union("exact", "near").alias(gone)), "marks")
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col(did)) & (_md5("text") == F.col(th)), "left")
    parts = F.split(F.col("text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull() | (F.size(gone) == 0), F.col("text")).otherwise(F.array_join(F.transform(left, lambda p: F.get(parts, p)), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else c_ for c, c_ in zip(docs.columns, quoted(docs.columns), strict=True)])


def line_report(docs: DataFrame, most: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_links of every document.

    n_lines: lines that are not empty; n_exact, n_near: those that go as copies and as near copies;
    n_links: links that its distinct lines have to other lines. Null texts have no lines, long texts and lines count whole, repeated
    rows give a row each, and an empty table none. Other columns are not read, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    found = decisions(docs, most)
    marks = removed_lines(docs, found).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.size("exact").alias("e"), F.size("near").alias("n"), F.col("n_links").alias("l"))
    own = docs.select("doc_id", _md5("text").alias("th"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")).alias("n_lines"))
    joined = own.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("doc_id", zero("n_lines").alias("n_lines"), zero("e").alias("n_exact"), zero("n").alias("n_near"), zero("l").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op2_line_dedup": query}

# Letters beyond ASCII that the given texts use. The SQL engine's edit distance counts bytes, so each of these
# letters becomes one of the control characters first, of which lines hold none; a letter beyond the list would count double there.
_WIDE = "áâäçèéêíîñóöúüßÄÇÈÉÊÍÑÓÖÜÀÁÂ"
_NARROW = " || ".join(f"chr({k})" for k in [*range(1, 9), 11, 12, *range(14, 32)])

ORACLE = {
    "op2_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, line, count(*) AS c FROM l WHERE line <> '' GROUP BY 1, 2),
g AS (SELECT line, min(doc_id) AS owner, sum(c) AS n, length(line) AS len, md5(line) AS tag,
             translate(line, '{_WIDE}', {_NARROW}) AS narrow
      FROM o GROUP BY line),
p AS (SELECT a.line AS a, b.line AS b, a.owner AS ao, b.owner AS bo, a.tag AS at_, b.tag AS bt FROM g a JOIN g b
      ON a.len BETWEEN b.len - 2 AND b.len + 2 AND a.line <> b.line
      WHERE levenshtein(a.narrow, b.narrow) <= 2 AND levenshtein(a.narrow, b.narrow) <= 0.2 * greatest(a.len, b.len)),
x AS (SELECT a AS line, count(*) AS links, bool_or(bo < ao OR (bo = ao AND bt < at_)) AS dropped FROM p GROUP BY a),
r AS (SELECT doc_id, sum(c) AS n_lines, sum(CASE WHEN coalesce(dropped, FALSE) THEN 0 ELSE c - CASE WHEN doc_id = owner THEN 1 ELSE 0 END END) AS n_exact,
             sum(CASE WHEN dropped THEN c ELSE 0 END) AS n_near, sum(coalesce(links, 0)) AS n_links
      FROM o JOIN g USING (line) LEFT JOIN x USING (line) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
}
