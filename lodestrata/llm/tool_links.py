"""Tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are two tables that meet by hash join on (conversation, identifier); both sides are
first brought to one row for each identifier by partial aggregation, so a conversation that
holds a third of all turns is spread by its identifiers. Calls may name others in their arguments as
{"$ref": "<id>"}, read from the parsed arguments, so it is of no account how an identifier is escaped. References give
each call its level (0: refers to none; n: one more than the highest it refers to), which orders a conversation
topologically: by (level, turn). Calls with one reference form chains, which are shortened by pointer doubling, in
as many rounds as the longest has binary digits; only calls with several references are then taken off level by
level. Arguments are checked against a schema by expressions over a variant value.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut
from .common import table

#: Tools of the registered query: every user or system turn asks for something in words, after what was asked before.
SCHEMAS = {
    "reply": {"text": {"type": "string", "required": True, "minLength": 1, "maxLength": 256}, "turn": {"type": "integer", "required": True, "minimum": 0}, "after": {"type": "object"}},
    "instruct": {"text": {"type": "string", "required": True, "minLength": 1}, "turn": {"type": "integer", "required": True, "maximum": 0}, "after": {"type": "object"}},
}

#: How a JSON type shows in the schema of a variant.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def json_string(value: Column) -> Column:
    """A string as a JSON string; null as null."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


#: Stand-ins for an escaped backslash and an escaped quote: control characters are never bare in JSON text.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _pieces(written: Column) -> Column:
    """JSON text cut at its quotes: pieces at odd places are strings (escaped as they stand), the others what lies between."""
    return F.split(F.replace(F.replace(written, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"')


def _escaped(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _number(token: Column) -> Column:
    """A JSON number in one form: no exponent where 38 digits hold it, no zeros at the end of a fraction."""
    value = token.try_cast("double")
    fixed = [token.try_cast(f"decimal(38,{places})") for places in (18, 0, 38)]
    held = F.coalesce(*[F.when(f.cast("double") == value, f.cast("string")) for f in fixed])
    plain = F.when(token.contains("E"), held).otherwise(token)
    short = F.when(plain.contains("."), F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(plain)
    return F.when(short == "-0", F.lit("0")).otherwise(F.coalesce(short, token))


def plain_numbers(written: Column) -> Column:
    """JSON text with every number in one form; strings stay."""

    def between(piece: Column) -> Column:
        tokens = F.regexp_extract_all(piece, F.lit("[-+.0-9E]+|[^-+.0-9E]+"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[.E]") & t.rlike("[0-9]"), _number(t)).otherwise(t)), "")

    parts = F.transform(_pieces(written), lambda p, i: F.when((i % 2 == 0) & p.rlike("[.E]"), between(p)).otherwise(p))
    return F.when(written.rlike("[0-9][.E]"), _escaped(F.array_join(parts, '"'))).otherwise(written)


def canonical(text: Column) -> Column:
    """JSON text with sorted keys, no white space and numbers in one form (1, 1.0 and 1e0 are 1; an exponent stays where
    38 digits do not hold a number). What is not JSON becomes a JSON string, and so does an object that repeats a key."""
    return F.coalesce(plain_numbers(F.to_json(F.try_parse_json(text))), json_string(text))


def references(arguments: Column) -> Column:
    """The identifiers that members named $ref hold anywhere in JSON text, as an array."""

    def found(pieces: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 2, F.lit(1))), lambda k: (k % 2 == 1) & (F.get(pieces, k) == "$ref") & (F.get(pieces, k + 1) == ":"))
        # a string is followed by its closing quote's piece, a number or an object is not
        return F.transform(at, lambda k: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), _escaped(F.get(pieces, k + 2)), F.lit('"'))), "$", "string"))

    written = F.to_json(F.try_parse_json(arguments))
    all_ = F.transform(F.array(_pieces(written)), found)[0]
    # asked of the parsed text, where a name is written in one way however it was escaped
    return F.when(written.contains('"$ref"'), F.coalesce(F.array_distinct(F.filter(all_, lambda x: x.isNotNull())), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def dialogue_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results: a user or system turn asks (its id is its turn) and refers to the turn two before, if that asks
    as well; an assistant turn answers the turn before it."""
    call_id = F.col("turn").cast("string")
    after = F.when(F.col("turn") >= 2, F.struct((F.col("turn") - 2).cast("string").alias("$ref")))
    arguments = F.to_json(F.struct(after.alias("after"), "text", "turn"))
    name = F.when(F.col("role") == "system", F.lit("instruct")).otherwise(F.lit("reply"))
    calls = messages.where("role in ('user', 'system')").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    answers = messages.where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), json_string(F.col("text")).alias("content"))
    return calls, answers


def tool_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls from assistant turns {"tool_calls": [{"id", "name", "arguments"}]} and results from tool turns {"tool_call_id", "content"}."""
    v = F.try_parse_json("text")
    listed = F.try_variant_get(v, "$.tool_calls", "array<variant>")
    one = messages.where("role = 'assistant' and text like '%tool_calls%'").select("conv_id", "turn", F.explode(listed).alias("c"))
    field = lambda name: F.try_variant_get("c", name, "string")
    arguments = F.try_variant_get("c", "$.arguments", "variant")
    # arguments come as an object or as text that holds one
    text = F.when(F.schema_of_variant(arguments) == "STRING", field("$.arguments")).otherwise(F.to_json(arguments))
    calls = one.select("conv_id", "turn", field("$.id").alias("call_id"), field("$.name").alias("name"), text.alias("arguments"))
    answers = messages.where("role = 'tool'").select(
        "conv_id", "turn", F.try_variant_get(v, "$.tool_call_id", "string").alias("call_id"), F.coalesce(F.to_json(F.try_variant_get(v, "$.content", "variant")), json_string(F.col("text"))).alias("content")
    )
    return calls, answers


def errors_of(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, in the order of the schema; an empty array if nothing."""
    value = F.try_parse_json(arguments)
    known = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        wrong = []
        for field, rule in fields.items():
            place = "$['" + field + "']"  # quoted, so that a name with a dot is one name
            kind = F.schema_of_variant(F.try_variant_get(value, place, "variant"))
            here, number = kind.isNotNull(), F.try_variant_get(value, place, "double")
            fits = kind.rlike(f"^({_TYPES[rule['type']]})$")
            if rule["type"] == "integer":  # by value: 1.0 is one, and so are whole numbers beyond 64 bits
                fits = fits | (kind.rlike(f"^({_TYPES['number']})$") & (number % 1 == 0))
            wrong.append(F.when(here & ~fits, F.lit(f"{field}: not a {rule['type']}")))
            if rule.get("required"):
                wrong.append(F.when(~here, F.lit(f"{field}: missing")))
            text = F.try_variant_get(value, place, "string")
            bounds = [("minLength", F.length(text), "short"), ("maxLength", F.length(text), "long"), ("minimum", number, "small"), ("maximum", number, "large")]
            for bound, size, what in bounds:
                if bound in rule:
                    beyond = size < rule[bound] if bound.startswith("min") else size > rule[bound]
                    wrong.append(F.when(here & beyond, F.lit(f"{field}: too {what}")))
            if "enum" in rule:
                wrong.append(F.when(here & ~text.isin(rule["enum"]), F.lit(f"{field}: not allowed")))
        others = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)))), lambda k: F.concat(k, F.lit(": not known")))
        found = F.concat(F.filter(F.array(*wrong), lambda w: w.isNotNull()), F.coalesce(others, F.array().cast("array<string>")))
        known = F.when(name == tool, found).otherwise(known)
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.array(F.lit("arguments: not JSON")))
        .when(~shape.startswith("OBJECT"), F.array(F.lit("arguments: not an object")))
        .otherwise(F.coalesce(known, F.array(F.lit("name: not a known tool"))))
    )


def node(conv_id: str, call_id: str) -> Column:
    """A call's name among all conversations: 128 bits of a text that tells nulls and identifiers apart."""
    return F.md5(F.to_json(F.struct(F.col(conv_id).alias("c"), F.col(call_id).alias("i"))))


def _jumps(single: DataFrame) -> DataFrame:
    """For calls with one reference (node, anchor, dist): the first call up the chain that is no such call, how far it is, and whether
    there is one at all (loose: the chain runs into a circle)."""
    rounds = max(1, single.count().bit_length())
    for _ in range(0, rounds, 2):  # two doublings for each written table
        for _ in range(2):
            other = single.select(F.col("node").alias("n2"), F.col("anchor").alias("a2"), F.col("dist").alias("d2"))
            met = single.join(other, F.col("anchor") == F.col("n2"), "left")
            single = met.select("node", F.coalesce("a2", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"))
        single = cut(single, "chains")
        if single.join(single.select(F.col("node").alias("n2")), F.col("anchor") == F.col("n2"), "left_semi").isEmpty():
            return single.withColumn("loose", F.lit(False))
    return cut(single.join(single.select(F.col("node").alias("n2")), F.col("anchor") == F.col("n2"), "left").select("node", "anchor", "dist", F.col("n2").isNotNull().alias("loose")), "chains")


def levels(calls: DataFrame) -> DataFrame | None:
    """(node, level) of the calls (conv_id, call_id, arguments) that refer to others of their conversation; level is null in and behind a
    circle. Other calls have level 0; without any reference there is no table."""
    named = calls.select(node("conv_id", "call_id").alias("child"), F.col("conv_id").alias("c"), F.explode(references(F.col("arguments"))).alias("i"))
    there = calls.select(node("conv_id", "call_id").alias("parent"))
    edges = cut(named.select("child", node("c", "i").alias("parent")).distinct().join(there, "parent", "left_semi").select("child", "parent"), "refs")
    if edges.isEmpty():
        return None
    fans = cut(edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("anchor")), "fans")
    single = _jumps(fans.where("n = 1").select(F.col("child").alias("node"), "anchor", F.lit(1).alias("dist")))
    several = _peeled(edges.join(fans.where("n > 1").select("child"), "child", "left_semi"), single)
    if several is None:
        return single.select("node", F.when(~F.col("loose"), F.col("dist")).alias("level"))
    top = several.select(F.col("node").alias("n2"), F.col("level").alias("l2"))
    level = F.when(F.col("loose"), None).when(F.col("n2").isNotNull(), F.col("l2") + F.col("dist")).otherwise(F.col("dist"))
    return single.join(top, F.col("anchor") == F.col("n2"), "left").select("node", level.cast("int").alias("level")).unionByName(several)


def _peeled(edges: DataFrame, single: DataFrame) -> DataFrame | None:
    """(node, level) of calls with several references, given the chains of all others. A round takes off the calls that wait for none
    that is left, so there are as many rounds as such calls on the longest path."""
    todo = edges.join(single, F.col("parent") == F.col("node"), "left")
    todo = todo.select("child", F.coalesce("anchor", "parent").alias("on"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.coalesce("loose", F.lit(False)).alias("loose"))
    own = todo.select(F.col("child").alias("n2")).distinct()
    waits = F.when(F.col("n2").isNotNull() & ~F.col("loose"), F.col("on"))
    todo = cut(todo.join(own, F.col("on") == F.col("n2"), "left").select("child", waits.alias("on"), "dist", "loose", F.lit(0).alias("base")), "several")
    done = None
    while not todo.isEmpty():
        waiting = cut(todo.where("on is not null or loose").select("child").distinct(), "waiting")
        ready = cut(todo.join(waiting, "child", "left_anti").groupBy("child").agg(F.max(F.col("base") + F.col("dist")).alias("level")), "level")
        if ready.isEmpty():
            rest = waiting.select(F.col("child").alias("node"), F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.unionByName(rest)
        now = ready.select(F.col("child").alias("node"), "level")
        done = now if done is None else done.unionByName(now)
        met = todo.join(waiting, "child", "left_semi").join(now, F.col("on") == F.col("node"), "left")
        todo = cut(met.select("child", F.when(F.col("node").isNull(), F.col("on")).alias("on"), "dist", "loose", F.coalesce("level", "base").alias("base")), "several")
    return done


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_id, turn, level, status, valid, errors, n_calls, n_results, json for every identifier.

    calls: conv_id, turn, call_id, name, arguments (JSON text); results: conv_id, turn, call_id, content
    (JSON text). status: linked; early (the result stands before its call); unanswered; orphan (no
    call; level, valid and errors are null). Of calls or results that share an identifier the first by turn, then by content,
    counts, and n_calls and n_results tell how many there are. Null identifiers and conversations are values
    like any other. turn is the call's, of orphans the result's. Very long arguments and contents count whole. Other columns are
    not read, whatever their names. Empty tables give no rows.
    """
    calls, results = calls.select("conv_id", "turn", "call_id", "name", "arguments"), results.select("conv_id", "turn", "call_id", "content")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    first = cut(first, "calls")
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")).withColumnsRenamed({"conv_id": "c2", "call_id": "i2"})
    met = first.hint("shuffle_hash").join(answer, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("call_id").eqNullSafe(F.col("i2")), "full")
    met = met.withColumn("called", F.col("n_calls").isNotNull()).withColumn("answered", F.col("n_results").isNotNull())
    ids = [F.when(F.col("called"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("conv_id", "c2"), ("call_id", "i2"))]
    met = met.select(*ids, "c", "r", "called", "answered", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    deep = levels(first.select("conv_id", "call_id", "c.arguments"))
    if deep is None:
        met = met.withColumn("deep", F.lit(0)).withColumn("ordered", F.lit(False))
    else:
        deep = deep.select(F.col("node").alias("n3"), F.col("level").alias("deep"), F.lit(True).alias("ordered"))
        met = met.withColumn("n", node("conv_id", "call_id")).join(deep, F.col("n") == F.col("n3"), "left")
    status = F.when(~F.col("answered"), "unanswered").when(~F.col("called"), "orphan").when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked")
    errors = F.when(F.col("called"), errors_of(F.col("c.name"), F.col("c.arguments"), schemas))
    out = met.select(
        "conv_id", "call_id", F.when(F.col("called"), F.col("c.turn")).otherwise(F.col("r.turn")).alias("turn"),
        F.when(F.col("called"), F.when(F.coalesce("ordered", F.lit(False)), F.col("deep")).otherwise(0)).cast("int").alias("level"),
        status.alias("status"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"), "n_calls", "n_results",
        F.when(F.col("called"), canonical(F.col("c.arguments"))).alias("_a"), F.col("c.name").alias("_n"), F.when(F.col("answered"), canonical(F.col("r.content"))).alias("_r"),
    )
    written = F.concat(
        F.lit('{"arguments":'), F.coalesce("_a", F.lit("null")), F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("_n")),
        F.lit(',"result":'), F.coalesce("_r", F.lit("null")), F.lit(',"status":"'), F.col("status"), F.lit('"}'),
    )
    return out.withColumn("valid", F.when(F.col("errors").isNotNull(), F.col("valid"))).withColumn("json", written).drop("_a", "_n", "_r")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says, tools = dialogue_events(messages), tool_events(messages)
    found = link(says[0].unionByName(tools[0]), says[1].unionByName(tools[1]))
    digest = F.sha2(F.encode("json", "UTF-8"), 256).alias("json_sha256")
    return found.select("conv_id", "call_id", "turn", "level", "status", "valid", F.size("errors").alias("n_errors"), "n_calls", "n_results", digest)


QUERIES = {"op1_tool_links": query}

ORACLE = {
    "op1_tool_links": """
WITH RECURSIVE c AS (
  SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, turn, CASE WHEN role = 'system' THEN 'instruct' ELSE 'reply' END AS name, text,
         count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM conversations WHERE role IN ('user', 'system')),
r AS (
  SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, turn, text, count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM conversations WHERE role = 'assistant'),
a AS (SELECT DISTINCT conv_id, turn FROM c),
v AS (SELECT conv_id, turn, 0 AS level FROM a WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL SELECT a.conv_id, a.turn, v.level + 1 FROM v JOIN a ON a.conv_id = v.conv_id AND a.turn = v.turn + 2 WHERE a.turn >= 2),
m AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.turn AS t, c.name, c.text AS asked, r.text AS said,
         coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, v.level,
         CASE WHEN r.call_id IS NULL THEN 'unanswered' WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END AS status,
         CASE WHEN c.turn IS NOT NULL THEN CASE WHEN c.text IS NULL OR length(c.text) < 1 OR (c.name = 'reply' AND length(c.text) > 256) THEN 1 ELSE 0 END
           + CASE WHEN c.name = 'instruct' AND c.turn > 0 OR c.name = 'reply' AND c.turn < 0 THEN 1 ELSE 0 END END AS n_errors
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN v ON c.conv_id = v.conv_id AND c.turn = v.turn)
SELECT conv_id, call_id, turn, level, status, n_errors = 0 AS valid, n_errors, n_calls, n_results,
       sha256('{"arguments":' || CASE WHEN t IS NULL THEN 'null' ELSE '{' || CASE WHEN t >= 2 THEN '"after":{"$ref":"' || (t - 2) || '"},' ELSE '' END
           || CASE WHEN asked IS NULL THEN '' ELSE '"text":' || CAST(to_json(asked) AS VARCHAR) || ',' END || '"turn":' || t || '}' END
         || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
         || ',"result":' || coalesce(CAST(to_json(said) AS VARCHAR), 'null') || ',"status":"' || status || '"}') AS json_sha256
FROM m
"""
}
