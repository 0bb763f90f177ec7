"""Model-reply parsing edge table (FIXTURES §3.2)."""

from pyspark.sql import functions as F

from hirelens.functions.jsonparse import get_or_default, parse_replies

FENCED = "```json\n{\"a\":[1]}\n```"
CASES = [
    ('{"a":[1]}', None), ('{"a":[1]}\n', None), (FENCED, None),
    ("```JSON\n{\"a\":[1]}\n```", "invalid_json"),
    ('{"a":[1]} junk', "invalid_json"), ('{"a":1} }', "invalid_json"), ('{"a":1}]', "invalid_json"),
    ('{"a":1},{"b":2}', "invalid_json"), ('[1],"y":2', "invalid_json"), ('{"a":01}', "invalid_json"),
    ('{"a":1,}', "invalid_json"), ("{'a':1}", "invalid_json"), ("x", "invalid_json"), ("", "invalid_json"),
    ("[1]", "not_object"), ('"s"', "not_object"), ("null", "not_object"),
    ('{"a":1,"a":2}', "invalid_json"), ('{"a":NaN}', "invalid_json"),
]


def test_reply_edge_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, raw string")
    got = {r.i: r.reason for r in parse_replies(df, "raw").collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, (text, got[i], want)


def test_missing_key_default_and_explicit_null(spark):
    df = spark.createDataFrame([(0, '{"b":1}'), (1, '{"a":null}'), (2, '{"a":7}'), (3, "junk")],
                               "i int, raw string")
    r = parse_replies(df, "raw").select("i", get_or_default(F.col("reply"), "a", "bigint", -1).alias("a"))
    got = {x.i: x.a for x in r.collect()}
    assert got == {0: -1, 1: None, 2: 7, 3: -1}
