"""Scoring scalars and the match report contract (FIXTURES §3.3)."""

import json

from pyspark.sql import functions as F

from hirelens.functions import scoring as S


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 0.19]], "s double")
    got = [r[0] for r in df.select(S.band(F.col("s"))).collect()]
    assert got == ["poor", "weak", "moderate", "good", "strong", "strong", "poor"]


def test_clamped_cosine_and_percent(spark):
    df = spark.createDataFrame([([0.6, 0.8], [-0.6, -0.8]), ([0.6, 0.8], [0.6, 0.8])],
                               "a array<float>, b array<float>")
    got = [round(r[0], 6) for r in df.select(S.cosine_clamped(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0]
    p = spark.createDataFrame([(0.625,), (0.635,), (0.5,)], "s double").select(S.percent(F.col("s")))
    assert [r[0] for r in p.collect()] == [62, 64, 50]


def test_match_report_example(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["d"], ["a", "d"])],
                               "req array<string>, pref array<string>, res array<string>")
    req, pref, res = F.col("req"), F.col("pref"), F.col("res")
    gap = S.gap(req, pref, res)
    r = df.select(S.matched(req, pref, res).alias("m"), gap.alias("g"),
                  S.match_score(req, pref, res).alias("s"),
                  S.band(S.match_score(req, pref, res)).alias("b"),
                  F.to_json(S.suggestions(gap, req)).alias("j")).first()
    assert r.m == ["a", "d"] and r.g == ["b", "c"]
    assert r.s == 0.428571 and r.b == "moderate"
    sug = json.loads(r.j)
    assert [s["priority"] for s in sug] == ["high", "high"]
    assert sug[0] == {"type": "add_skill", "text": "Add b to your resume", "priority": "high"}


def test_nothing_to_match_scores_zero(spark):
    df = spark.createDataFrame([([], [], ["x"])], "req array<string>, pref array<string>, res array<string>")
    assert df.select(S.match_score(F.col("req"), F.col("pref"), F.col("res"))).first()[0] == 0.0


def test_score_eval_weighs_every_label(spark):
    from hirelens.operators.matching import score_eval
    names = [f"tool {k}" for k in range(30)]
    found = spark.createDataFrame([(1, names[:15]), (2, []), (3, names)], "doc_id long, skills array<string>")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (9, 0)], "doc_id long, quality int")
    dictionary = spark.createDataFrame([(n, 1, 2) for n in names], "skill string, labels long, n_words int")
    got = {r.quality: (r.docs, r.mean_percent, r.mean_abs_error) for r in score_eval(found, labels, dictionary).collect()}
    assert got == {1: (2, 25.0, 35.0), 0: (2, 50.0, 50.0)}


def test_score_eval_sql_has_no_list_of_its_own():
    from hirelens.plans.oracle import ORACLE
    assert " IN ('" not in ORACLE["score_eval"].split("hits AS")[1]
