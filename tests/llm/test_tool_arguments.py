"""Arguments of tool calls: references however they are escaped, integers by value, names with dots."""

from pyspark.sql import functions as F

from lodestrata.llm import tool_links


def test_references_however_they_are_escaped(spark):
    texts = ['{"$ref":"b"}', '{"\\u0024ref":"b"}', '{"$r\\u0065f":"b"}', '{"\\u0024\\u0072\\u0065\\u0066":"\\u0062"}', '{"a":[{"x":{"$ref":"b"}}]}', '{"ref":"b"}', '{"a":"$ref"}', '{"a":"\\"$ref\\":\\"b\\""}', "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tool_links.references(F.col("t")).alias("r")).collect()
    assert [r.r for r in sorted(rows)] == [["b"]] * 5 + [[]] * 5


def test_integers_by_value_and_names_with_dots(spark):
    schema = {"f": {"n": {"type": "integer", "minimum": 0}, "a.b": {"type": "string", "required": True}}}
    texts = ['{"a.b":"x","n":1}', '{"a.b":"x","n":1.0}', '{"a.b":"x","n":1e2}', '{"a.b":"x","n":12345678901234567890}', '{"a.b":"x","n":1.5}', '{"a.b":"x","n":"1"}', '{"a":{"b":"x"}}', '{"a.b":"x","n":-1.0}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tool_links.errors_of(F.lit("f"), F.col("t"), schema).alias("e")).collect()
    assert [r.e for r in sorted(rows)] == [[], [], [], [], ["n: not a integer"], ["n: not a integer"], ["a.b: missing", "a: not known"], ["n: too small"]]
