"""Skill dictionary, extraction (M1, M2), requests (P10, J3, P17) and the report (M3-M5)
on hand-made rows; the stand-in data exercises every branch of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hirelens.operators import matching as M
from hirelens.operators import skills as SK
from hirelens.plans import registry as R

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    names = ["Go", "C#", "C++", "R", "Node.js", "machine  Learning", "go", "", None, "--",
             "Search Engine Optimisation Lead"]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "skill_abr long, skill_name string")


@pytest.fixture(scope="module")
def dictionary(labels):
    return SK.label_dictionary(labels)


def test_dictionary_keeps_short_and_long_labels(dictionary):
    got = {r.skill: (r.labels, r.n_words) for r in dictionary.collect()}
    assert got == {"go": (2, 1), "c#": (1, 1), "c++": (1, 1), "r": (1, 1), "node.js": (1, 1),
                   "machine learning": (1, 2), "search engine optimisation lead": (1, 4)}


def test_extract_skills_hand_made(spark, dictionary):
    texts = spark.createDataFrame(
        [(1, "I write Go. And C#, r; Node.js.\nMachine\nlearning!"), (2, None), (3, ""),
         (4, "gopher going rust"), (5, "search engine optimisation"),
         (6, "Lead: SEARCH ENGINE OPTIMISATION LEAD..."), (7, "c++/c++ c")], "id long, text string")
    got = {r.id: r.skills for r in SK.extract_skills(texts, ["id"], "text", dictionary).collect()}
    assert got == {1: ["c#", "go", "machine learning", "node.js", "r"], 2: [], 3: [], 4: [], 5: [],
                   6: ["search engine optimisation lead"], 7: ["c++"]}


def test_empty_dictionary_and_empty_texts(spark, labels, dictionary):
    none = SK.label_dictionary(labels.limit(0))
    texts = spark.createDataFrame([(1, "go")], "id long, text string")
    assert [tuple(r) for r in SK.extract_skills(texts, ["id"], "text", none).collect()] == [(1, [])]
    assert SK.extract_skills(texts.limit(0), ["id"], "text", dictionary).count() == 0


def test_posting_lines(spark, dictionary):
    posts = spark.createDataFrame(
        [(1, "Must know Go.\nNice to have: C#, Go\nR is a PLUS"), (2, "Bonus: c++"), (3, None), (4, "none")],
        "id long, text string")
    got = {r.id: (r.required_skills, r.preferred_skills)
           for r in SK.posting_skills(posts, ["id"], "text", dictionary).collect()}
    assert got == {1: (["go"], ["c#", "r"]), 2: ([], ["c++"]), 3: ([], []), 4: ([], [])}


def test_posting_role_and_company(spark):
    df = spark.createDataFrame([("Great job\n Title :  Data engineer \nCompany: Acme, Inc.\nrole: x",),
                                ("no such line: title",), (None,)], "t string")
    got = [tuple(r) for r in df.select(SK.posting_role(F.col("t")), SK.posting_company(F.col("t"))).collect()]
    assert got == [("Data engineer", "Acme, Inc."), ("", ""), ("", "")]


RESUMES = [(1, 7, "Go and R"), (2, 8, ""), (3, 7, "c# only")]
REQUESTS = [(10, 1, 7, 5, " Role: dev\nMust know Go, C++\nBonus: R, C# ", None),
            (11, None, 7, None, "Go", "student"), (12, 1, 7, None, " \n\t", "student"),
            (13, 1, 8, None, "Go", "student"), (14, 99, 7, None, "Go", "student"),
            (15, 2, 8, None, "Company: Acme\nGo", "mid_level"), (16, 3, 7, None, "nothing", "student")]


@pytest.fixture(scope="module")
def asked(spark):
    res = spark.createDataFrame(RESUMES, "resume_id long, user_id long, raw_text string")
    req = spark.createDataFrame(REQUESTS, "request_id long, resume_id long, user_id long, "
                                "application_id long, jd_text string, level string")
    return res, M.request_outcomes(req, res)


def test_request_outcomes(asked):
    got = {r.request_id: r.outcome for r in asked[1].collect()}
    assert got == {10: M.ACCEPTED, 11: M.NO_RESUME, 12: M.NO_TEXT, 13: M.NOT_FOUND, 14: M.NOT_FOUND,
                   15: M.ACCEPTED, 16: M.ACCEPTED}


def test_report_and_append(asked, dictionary):
    res, checked = asked
    ok = checked.filter(F.col("outcome") == M.ACCEPTED)
    report = M.match_report(ok, res, dictionary)
    got = {r.request_id: r for r in report.collect()}
    assert set(got) == {10, 15, 16}
    a = got[10]
    assert (a.level, a.jd_role, a.jd_company) == ("fresher", "dev", "")
    assert (a.required_skills, a.preferred_skills) == (["c++", "go"], ["c#", "r"])
    assert (a.matched_skills, a.gap_skills) == (["go", "r"], ["c#", "c++"])
    assert a.match_score == 0.5 and a.band == "moderate"          # (1 + 0.5) / (2 + 1)
    assert [s["priority"] for s in json.loads(a.suggestions)] == ["medium", "high"]
    assert (got[15].resume_skills, got[15].match_score, got[15].jd_company) == ([], 0.0, "Acme")
    assert (got[16].match_score, got[16].suggestions) == (0.0, "[]")
    rows = {r.resume_id: r for r in M.analysis_rows(report, ok, "2024-02-01 00:00:00").collect()}
    assert (rows[1].application_id, rows[1].jd_text[:5], rows[1].user_id) == (5, "Role:", 7)
    assert all(r.score_ok for r in rows.values()) and len({r.id for r in rows.values()}) == 3
    j = {r.request_id: json.loads(r.json) for r in M.analysis_json(report, ["request_id"]).collect()}
    assert j[15]["application_id"] is None and j[10]["suggestions"][0]["type"] == "add_skill"


def test_dictionary_beyond_the_broadcast_bound(spark):
    """No join is forced: with broadcasts off, a dictionary of 20,000 labels gives the
    rows of a plain search."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    names = sorted({" ".join(rnd.choices(words, k=rnd.choice([1, 2, 2, 3]))) for _ in range(20_000)})
    texts = [(i, " ".join(rnd.choices(words, k=60))) for i in range(40)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        dic = SK.label_dictionary(spark.createDataFrame([(n,) for n in names], "skill_name string"))
        out = SK.extract_skills(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", dic)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.skills for r in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    known = set(names)
    for i, t in texts:
        w = re.split(" ", t)
        runs = {" ".join(w[p:p + n]) for n in (1, 2, 3) for p in range(len(w) - n + 1)}
        assert got[i] == sorted(runs & known)


def _plain(text, known, longest):
    w = [t for t in re.sub(r"[^a-z0-9+#.]+", " ", text.lower()).split(" ") if t]
    w = [t for t in (re.sub(r"\.+(?![a-z0-9])", "", t) for t in w) if t]
    return sorted({" ".join(w[p:p + n]) for p in range(len(w)) for n in range(1, longest + 1) if p + n <= len(w)} & known)


def test_labels_of_many_words(spark):
    """Labels of up to 200 words among 20,000, with others that share their beginnings; the
    texts hold them whole, cut short and changed in the last word."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    names = {" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(20_000)}
    long = rnd.choices(words, k=200)
    names |= {" ".join(long[:n]) for n in (4, 5, 8, 9, 16, 17, 31, 32, 33, 64, 130, 199, 200)}
    names |= {" ".join([*long[:20], "x", *long[21:40]])}
    texts = [" ".join(rnd.choices(words, k=80)) for _ in range(20)]
    texts += [" ".join(["a", *long[:n], "b"]) for n in (3, 12, 32, 33, 100, 199, 200)] + [" ".join([*long[:-1], "z"])]
    texts += [" ".join([*long[:20], "x", *long[21:40]]), " ".join(long) + " " + " ".join(long), texts[0]]
    rows = [(i % 29, t) for i, t in enumerate(texts)] + [(None, texts[-2]), (3, None), (40, "")]
    dic = SK.label_dictionary(spark.createDataFrame([(n,) for n in sorted(names)], "skill_name string"))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.skills for r in SK.extract_skills(df, ["id"], "text", dic).collect()}
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).update(_plain(t or "", names, 200))
    assert got == {i: sorted(x) for i, x in want.items()}
    assert any(len(s.split()) == 200 for s in got[None])


def test_positions_carry_no_more_than_the_stride(spark):
    """The plan's columns don't grow with the longest label, and only runs of lengths that
    labels with that first term have are built."""
    labels = [("a " * 150).strip(), "b c", "d"]
    dic = SK.label_dictionary(spark.createDataFrame([(x,) for x in labels], "skill_name string"))
    out = SK.extract_skills(spark.createDataFrame([(1, "b c d " + "a " * 150)], "id long, text string"), ["id"], "text", dic)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "w3" in plan and "w4" not in plan
    assert out.first().skills == sorted(labels)
    assert SK.prefix_levels(200) == [4, 8, 16, 32, 64, 128] and SK.prefix_levels(4) == []


def test_stand_in_data_reaches_every_branch(spark):
    rep = R.QUERIES["match_report"](spark, D).select(
        "band", "level", F.size("preferred_skills").alias("p"), "suggestions").collect()
    assert {r.band for r in rep} == {"strong", "good", "moderate", "weak", "poor"}
    assert {r.level for r in rep} == {"fresher", "student", "early_career", "mid_level"}
    assert any(r.p for r in rep)
    assert {s["priority"] for r in rep for s in json.loads(r.suggestions)} == {"high", "medium"}
    outcomes = {r.outcome for r in R.QUERIES["analysis_requests"](spark, D).select("outcome").collect()}
    assert outcomes == {M.NO_RESUME, M.NO_TEXT, M.NOT_FOUND, M.ACCEPTED}
    posts = R.QUERIES["posting_skills"](spark, D).collect()
    assert len(posts) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert any(r.preferred_skills for r in posts) and all(r.jd_role for r in posts)


def test_posting_skills_are_shuffled_once(spark):
    from hirelens.operators.skills import posting_skills
    d = spark.createDataFrame([("go", 1, 1), ("sql", 1, 1), ("c#", 1, 1)], "skill string, labels long, n_words int")
    posts = spark.createDataFrame([(1, "Must know go, sql.\nbonus: SQL c#"), (2, None), (None, "plus go"), (1, "go")],
                                  "id long, t string")
    out = posting_skills(posts, ["id"], "t", d)
    assert {r.id: (r.required_skills, r.preferred_skills) for r in out.collect()} == {
        1: (["go", "sql"], ["c#"]), 2: ([], []), None: ([], ["go"])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(id" in x and "skill" in x.split("),")[0]]
