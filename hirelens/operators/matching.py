"""Resume × posting analysis in bulk.

Pairs are explicit (an equi-join of request keys), never a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.functions import scoring as S
from hirelens.functions.text import py_strip
from hirelens.operators import nearest
from hirelens.operators.skills import (extract_skills, posting_company, posting_role,
                                       posting_skills, tokens)
from hirelens.schemas import DEFAULT_LEVEL, EXPECTED_PERCENT, SUGGESTION


# request outcomes, in the order they are checked
NO_RESUME, NO_TEXT, NOT_FOUND, ACCEPTED = (
    "resume_id missing", "jd_text missing", "resume not found", "accepted")


def request_outcomes(requests: DataFrame, resumes: DataFrame) -> DataFrame:
    """P10 + J3: every analysis request (request_id, resume_id, user_id, application_id,
    jd_text, level) with its outcome. A request needs a resume id, a posting text that is
    not blank (it is stored stripped) and a resume of the requesting user; one without a
    level is read as the default one (P17)."""
    own = resumes.select("resume_id", "user_id", F.lit(True).alias("_own"))
    text = py_strip(F.coalesce(F.col("jd_text"), F.lit("")))
    j = (requests.withColumn("jd_text", text)
         .withColumn("level", F.coalesce(F.col("level"), F.lit(DEFAULT_LEVEL)))
         .join(own, ["resume_id", "user_id"], "left"))
    outcome = (F.when(F.col("resume_id").isNull(), NO_RESUME)
               .when(F.col("jd_text") == "", NO_TEXT)
               .when(F.col("_own").isNull(), NOT_FOUND).otherwise(ACCEPTED))
    return j.select("request_id", "resume_id", "user_id", "application_id", "jd_text", "level",
                    outcome.alias("outcome"))


def match_report(requests: DataFrame, resumes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """M1 + M2 + M3 + M4 + N5 for every accepted request: skills are extracted once per
    posting text and once per requested resume, then joined by resume id."""
    ids = ["request_id", "resume_id", "user_id", "application_id", "level"]
    named = requests.select(*ids, posting_role(F.col("jd_text")).alias("jd_role"),
                            posting_company(F.col("jd_text")).alias("jd_company"), "jd_text")
    post = posting_skills(named, [*ids, "jd_role", "jd_company"], "jd_text", dictionary)
    asked = resumes.select("resume_id", "raw_text").join(
        requests.select("resume_id").distinct(), "resume_id", "left_semi")
    res = extract_skills(asked, ["resume_id"], "raw_text", dictionary)
    j = post.join(res, "resume_id")
    req, pref, rs = F.col("required_skills"), F.col("preferred_skills"), F.col("skills")
    gap = S.gap(req, pref, rs)
    score = S.match_score(req, pref, rs)
    return j.select(
        *ids, rs.alias("resume_skills"), "required_skills", "preferred_skills",
        "jd_role", "jd_company",
        S.matched(req, pref, rs).alias("matched_skills"), gap.alias("gap_skills"),
        score.alias("match_score"), S.band(score).alias("band"),
        F.to_json(S.suggestions(gap, req)).alias("suggestions"))


def analysis_json(report: DataFrame, keys: list[str]) -> DataFrame:
    """S12 + N4 + N6: each stored analysis as one JSON object, suggestions decoded back
    into the object (not left as a string). Absent values are written as null."""
    sugg = F.from_json(F.col("suggestions"), T.ArrayType(SUGGESTION))
    body = report.withColumn("suggestions", sugg)
    return body.select(*keys, F.to_json(F.struct(*[F.col(c) for c in body.columns]),
                                        {"ignoreNullFields": "false"}).alias("json"))


def analysis_rows(report: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """C7 + P13: the rows appended to the analyses table, with a derived id and the
    score CHECK (0 <= score <= 1; null passes) as a flag. Unlike the reference's insert,
    preferred and resume skills are kept too."""
    id_ = F.sha2(F.col("request_id").cast("string"), 256)
    score_ok = F.col("match_score").isNull() | F.col("match_score").between(0.0, 1.0)
    return (report.join(requests.select("request_id", "jd_text"), "request_id")
            .select(id_.alias("id"), "user_id", "resume_id", "application_id", "jd_text", "jd_role",
                    "jd_company", "required_skills", "preferred_skills", "resume_skills",
                    "matched_skills", "gap_skills", "match_score", "suggestions",
                    F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
                    score_ok.alias("score_ok")))


def lexical_pair_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """J4 + V2 with a term-frequency encoder: cosine of the two texts' L2-normalised
    term-count vectors, clamped to [0, 1], rounded to 6; plus the percent (M5).

    Sparse and shuffle-light: token counts per (pair, token) are a partial aggregate,
    the dot product and norms a second one per pair."""
    a = pairs.select(*keys, F.explode(tokens(F.col("resume_text"))).alias("tok"),
                     F.lit(1).alias("ca"), F.lit(0).alias("cb"))
    b = pairs.select(*keys, F.explode(tokens(F.col("jd_text"))).alias("tok"),
                     F.lit(0).alias("ca"), F.lit(1).alias("cb"))
    tf = a.unionByName(b).groupBy(*keys, "tok").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    agg = tf.groupBy(*keys).agg(
        F.sum(F.col("ca") * F.col("cb")).cast("double").alias("dot"),
        F.sum(F.col("ca") * F.col("ca")).cast("double").alias("na"),
        F.sum(F.col("cb") * F.col("cb")).cast("double").alias("nb"))
    cos = F.when((F.col("na") > 0) & (F.col("nb") > 0),
                 F.col("dot") / (F.sqrt("na") * F.sqrt("nb"))).otherwise(F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 6)
    out = pairs.select(*keys).join(agg, keys, "left")
    score = F.coalesce(score, F.lit(0.0))
    return out.select(*keys, score.alias("score"), S.percent(score).alias("percent"))


def score_eval(doc_skills: DataFrame, labels: DataFrame, reference: DataFrame) -> DataFrame:
    """M5 over labelled documents: score = share of the reference skill list (rows of
    ``skill``) that a document names; percent = round(score*100); error = |percent -
    expected|. One row per quality class with its mean percent and mean absolute error."""
    n = F.lit(float(max(1, reference.count())))
    hits = (doc_skills.select("doc_id", F.explode("skills").alias("skill"))
            .join(reference.select("skill"), "skill").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("hits")))
    scored = (labels.select("doc_id", "quality").join(hits, "doc_id", "left")
              .withColumn("score", F.round(F.coalesce(F.col("hits"), F.lit(0)) / n, 6))
              .withColumn("percent", S.percent(F.col("score")))
              .withColumn("error", F.abs(F.col("percent") - F.lit(EXPECTED_PERCENT))))
    return scored.groupBy("quality").agg(
        F.count(F.lit(1)).alias("docs"),
        F.round(F.avg("percent"), 6).alias("mean_percent"),
        F.round(F.avg("error"), 6).alias("mean_abs_error"))


# ---- V3: exact top-k vector matches --------------------------------------------


def top_matches(resumes: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """V3: for every resume vector (vec_id, embedding), the k postings with the highest
    clamped cosine (ties by posting id; vectors are normalised here, a zero vector scores
    0), by the pruned search of ``nearest``."""
    best = nearest.top_k(resumes.select(F.col("vec_id").alias("resume_id"), F.col("embedding").alias("vec")),
                         postings.select(F.col("vec_id").alias("posting_id"), F.col("embedding").alias("vec")), k)
    return best.withColumn("score", F.round("score", 6))
