"""Edge table for the description cleaning (FIXTURES §3.1)."""

import pytest
from pyspark.sql import functions as F

from hirelens.functions.text import (clean_description, clean_description_plain, clean_skill,
                                     week_monday, with_clean_text)

NBSP = " "
CASES = [
    ("pay: 5\rstill\nend", "end"),
    ("ſchedule: x", ""),
    (f"a{NBSP}b http://x{NBSP}kept", "a b kept"),
    ("Pay: $18-20/hour\nnext line", "next line"),
    ("x y salary : 5 z\nkeep", "x y keep"),
    ("repay: lost\nkept", "re kept"),
    ("wage: no newline", "wage no newline"),
    ("We are Committed to\nall diversity drop this", ""),
    ("Benefits: gone\nall gone", ""),
    ("a@b.c <b>hi</b>\r\nend", "hi end"),
    ("café C++ C# .NET", "caf C++ C# .NET"),
    (None, ""),
    ("   \t ", ""),
]


EXTRA = [("<p>x</p> $5/hour and: y\nsalary: z\nEqual Opportunity Employer rest", "x and y"),
         ("no triggers here, just words: none", "no triggers here, just words none")]


def test_clean_description_edges(spark):
    cases = CASES + EXTRA
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_description(F.col("t")).alias("c")).collect()}
    fast = {r.i: r.c for r in with_clean_text(df, "t", "c").collect()}
    plain = {r.i: r.c for r in df.select("i", clean_description_plain(F.col("t")).alias("c")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (cases[i][0], got[i], want)
        assert fast[i] == want, (cases[i][0], fast[i], want)
        assert plain[i] == want, (cases[i][0], plain[i], want)


def test_clean_skill_missing_and_spaces(spark):
    df = spark.createDataFrame([(" SQL ",), (None,), (" Python\t",)], "s string")
    got = [r[0] for r in df.select(clean_skill(F.col("s"))).collect()]
    assert got == ["sql", "", "python"]


@pytest.mark.parametrize("ts,monday", [("2024-01-07 10:00:00", "2024-01-01"),
                                       ("2024-01-01 00:00:00", "2024-01-01")])
def test_monday_week(spark, ts, monday):
    df = spark.createDataFrame([(ts,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert str(df.select(week_monday(F.col("t"))).first()[0]) == monday


def test_guarded_cleaning_equals_plain_on_random_texts(spark):
    import random
    rnd = random.Random(7)
    pieces = ["pay", "Salary", " : ", ":", "\n", "\r", "$", "12,5", "/hour", "http", "www.", "x.com",
              "@", "<b>", "</b>", ">", "<", " ", " ", "ſ", "K", "İ", "café",
              "Equal Opportunity Employer", "we are COMMITTED to", "diversity", "all qualified",
              "applicants", "Job Type", "benefits", "Schedule", "work location", "expected hours",
              "please send", "resume", "cv", "C++", "C#", ".NET", "abc", "\t", "-", "/", "#"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    diff = df.filter(clean_description(F.col("t")) != clean_description_plain(F.col("t")))
    assert diff.count() == 0, diff.limit(3).collect()


def test_terms_and_tail_without_patterns(spark):
    """Reading bytes as Latin-1 and translating gives what the patterns gave."""
    from hirelens.functions.text import _tail
    from hirelens.operators.skills import terms, tokens
    odd = ["".join(map(chr, range(300))), "Go. node.js ..+x a..b  c# üK😀İx", "", " ", None, "a\x01\x01 b\x00.", "ſK é z."]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    t = F.col("t")

    def split(pattern):
        return F.array_remove(F.split(F.lower(t), pattern), "")

    got = df.select(
        tokens(t).eqNullSafe(split(r"[^a-z0-9+#.]+")).alias("tokens"),
        terms(t).eqNullSafe(split(r"(?:[^a-z0-9+#.]|\.++(?![a-z0-9]))+")).alias("terms"),
        _tail(t).eqNullSafe(F.trim(F.regexp_replace(t, r"[^a-zA-Z0-9.,\-/+#]+", " "))).alias("tail"))
    assert all(all(r) for r in got.collect())
    assert "regexp" not in df.select(tokens(t), _tail(t))._jdf.queryExecution().optimizedPlan().toString()
