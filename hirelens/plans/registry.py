"""Query registry: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through the adapters and runs one of the
library's operators over the whole tables. ``QUERIES`` keeps insertion order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions.jsonparse import get_or_default, parse_replies
from hirelens.functions.text import with_clean_text
from hirelens.operators import changes as CH
from hirelens.operators import (corpus, encoder, matching, skills, term_vectors, tracker, trends,
                                vectors)
from hirelens.plans.params import (AS_OF, EMBEDDING_DIM, EMBEDDING_MODEL, MODEL_CHARS,
                                   TOP_MATCHES, TRAINED_AT)
from hirelens.schemas import FOREIGN_KEYS, JOB_SKILLS, POSTINGS, RECENT_ANALYSES, SKILLS
from hirelens.session import materialize, shared_path
from hirelens.sources import adapters as A
from hirelens.sources import csvio, intake, sinks, tenant, versioned
from hirelens.sources.tables import read_table
from hirelens.streaming import closing, weekly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _final(spark, d):
    return corpus.corpus_final(A.postings(spark, d), A.job_skills(spark, d), A.skills(spark, d))


# ---- corpus job -------------------------------------------------------------

@register("category_top30")
def q_category_top30(spark, d):
    return corpus.category_top(_final(spark, d))


@register("job_skill_lists")
def q_job_skill_lists(spark, d):
    return corpus.skill_lists(A.job_skills(spark, d), A.skills(spark, d))


@register("corpus_dedup")
def q_corpus_dedup(spark, d):
    return (corpus.keep_first(A.postings(spark, d)).filter("_kept")
            .select("job_id", "title", "description", "formatted_experience_level"))


@register("experience_dist")
def q_experience_dist(spark, d):
    return corpus.experience_dist(_final(spark, d))


@register("clean_documents")
def q_clean_documents(spark, d):
    return with_clean_text(read_table(spark, d, "documents", "doc_id", "text"), "text",
                           "clean_text").select("doc_id", "clean_text")


@register("clean_pages")
def q_clean_pages(spark, d):
    return with_clean_text(read_table(spark, d, "pages", "page_id", "html"), "html",
                           "clean_text").select("page_id", "clean_text")


@register("corpus_final")
def q_corpus_final(spark, d):
    return _final(spark, d)


@register("corpus_funnel")
def q_corpus_funnel(spark, d):
    return corpus.corpus_funnel(A.postings(spark, d), A.job_skills(spark, d), A.skills(spark, d))


@register("corpus_metadata")
def q_corpus_metadata(spark, d):
    return corpus.corpus_metadata(_final(spark, d), TRAINED_AT, EMBEDDING_MODEL, EMBEDDING_DIM)


# ---- tracker ----------------------------------------------------------------


@register("tracker_list")
def q_tracker_list(spark, d):
    return tracker.tracker_list(A.applications(spark, d))


@register("tracker_list_by_status")
def q_tracker_list_by_status(spark, d):
    return tracker.tracker_list(A.applications(spark, d), status="interview")


@register("status_counts")
def q_status_counts(spark, d):
    return tracker.status_counts(A.applications(spark, d))


@register("status_wide")
def q_status_wide(spark, d):
    return tracker.status_wide(A.applications(spark, d))


@register("status_map")
def q_status_map(spark, d):
    return tracker.status_map(A.applications(spark, d))


@register("tracker_board")
def q_tracker_board(spark, d):
    return tracker.tracker_board(A.applications(spark, d))


@register("latest_per_user")
def q_latest_per_user(spark, d):
    return tracker.latest_per_user(A.analyses(spark, d), ["id", "created_at", "level"])


@register("owned_lookup")
def q_owned_lookup(spark, d):
    req = A.change_sets(spark, d).filter(F.col("op") != "insert").select("seq", "id", "user_id")
    return tracker.owned_lookup(req, A.applications(spark, d))


# ---- trends -----------------------------------------------------------------

UPSERT_BASE_BEFORE = "1998-01-01"      # stored weeks: analyses before this day
UPSERT_BATCH_FROM = "1997-12-01"       # recomputed batch: analyses from this day (a Monday)


@register("recent_skill_trends")
def q_recent_skill_trends(spark, d):
    return trends.recent_skill_counts(A.analyses(spark, d, newest=RECENT_ANALYSES))


@register("weekly_trends")
def q_weekly_trends(spark, d):
    return trends.weekly_trends(A.analyses(spark, d))


@register("weekly_trends_json_lists")
def q_weekly_trends_json_lists(spark, d):
    """The weekly table from analyses whose skill lists are stored as JSON text."""
    a = A.analyses(spark, d)
    return trends.weekly_trends(a.withColumn("required_skills", F.to_json("required_skills")))


@register("rising_skills")
def q_rising_skills(spark, d):
    return trends.rising_skills(trends.weekly_trends(A.analyses(spark, d)))


@register("rising_skills_calendar")
def q_rising_skills_calendar(spark, d):
    return trends.rising_skills_calendar(trends.weekly_trends(A.analyses(spark, d)))


@register("trend_feed")
def q_trend_feed(spark, d):
    return trends.trend_feed(corpus.category_top(_final(spark, d)),
                             trends.recent_skill_counts(A.analyses(spark, d, newest=RECENT_ANALYSES)))


@register("retrain_check")
def q_retrain_check(spark, d):
    return trends.retrain_check(A.analyses(spark, d))


@register("trend_upsert")
def q_trend_upsert(spark, d):
    a = A.analyses(spark, d)
    base = trends.weekly_trends(a.filter(F.col("created_at") < F.lit(UPSERT_BASE_BEFORE).cast("timestamp_ntz")))
    new = trends.weekly_trends(a.filter(F.col("created_at") >= F.lit(UPSERT_BATCH_FROM).cast("timestamp_ntz")))
    return trends.upsert(base, new)


@register("trend_deltas")
def q_trend_deltas(spark, d):
    """The weekly table kept up to date: counts stored for the analyses before 1998, then
    one change with the later analyses appended, some deleted and some moved by a week and
    shortened by a skill; equal to a full computation over the result."""
    a = materialize(A.analyses(spark, d), "analyses")
    before = F.col("created_at") < F.lit(UPSERT_BASE_BEFORE).cast("timestamp_ntz")
    old, k = a.filter(before), F.col("id")
    base = shared_path(spark, "weekly-counts")
    trends.create_weekly_counts(old, base)
    deleted, changed = old.filter(k % 29 == 3), old.filter((k % 29 != 3) & (k % 31 == 5))
    n = F.size("required_skills")
    moved = changed.withColumns({"created_at": F.col("created_at") + F.expr("INTERVAL 7 DAYS"),
                                 "required_skills": F.slice("required_skills", 1, F.greatest(n - 1, F.lit(0)))})
    trends.apply_deltas(spark, base, deleted.unionByName(changed), a.filter(~before).unionByName(moved))
    return trends.trends_of(versioned.read_version(spark, base))


# ---- model replies, skills and matching ---------------------------------------


def _dictionary(spark, d):
    """The skill label table as a dictionary, written once: its uses read it back and
    Spark knows its size in bytes."""
    return materialize(skills.label_dictionary(A.skills(spark, d)), "skill-dictionary")


@register("safe_parse_json")
def q_safe_parse_json(spark, d):
    r = parse_replies(A.model_replies(spark, d), "raw")
    return r.select("event_id", F.col("reply").isNotNull().alias("ok"), "reason",
                    get_or_default(F.col("reply"), "k", "bigint", 0).alias("k"))


@register("skill_dictionary")
def q_skill_dictionary(spark, d):
    return skills.label_dictionary(A.skills(spark, d))


@register("doc_skills")
def q_doc_skills(spark, d):
    texts = A.posting_texts(spark, d).withColumnRenamed("job_id", "doc_id")
    return skills.extract_skills(texts, ["doc_id"], "text", _dictionary(spark, d))


@register("posting_skills")
def q_posting_skills(spark, d):
    posts = A.posting_texts(spark, d)
    named = posts.select("job_id", skills.posting_role(F.col("text")).alias("jd_role"),
                         skills.posting_company(F.col("text")).alias("jd_company"), "text")
    return skills.posting_skills(named, ["job_id", "jd_role", "jd_company"], "text",
                                 _dictionary(spark, d))


@register("analysis_requests")
def q_analysis_requests(spark, d):
    return matching.request_outcomes(A.analysis_requests(spark, d), A.resumes(spark, d))


def _report(spark, d):
    """(accepted requests, their report); the inputs that several branches read are
    written once."""
    res = materialize(A.resumes(spark, d), "resumes")
    checked = matching.request_outcomes(A.analysis_requests(spark, d), res)
    accepted = materialize(checked.filter(F.col("outcome") == matching.ACCEPTED), "requests")
    return accepted, matching.match_report(accepted, res, _dictionary(spark, d))


@register("match_report")
def q_match_report(spark, d):
    return _report(spark, d)[1]


@register("analysis_json_out")
def q_analysis_json_out(spark, d):
    return matching.analysis_json(_report(spark, d)[1], ["request_id"])


@register("analysis_append")
def q_analysis_append(spark, d):
    accepted, report = _report(spark, d)
    return matching.analysis_rows(report, accepted, AS_OF)


@register("score_eval")
def q_score_eval(spark, d):
    dic = _dictionary(spark, d)
    labels = read_table(spark, d, "labels", "doc_id", "quality")
    texts = A.posting_texts(spark, d).withColumnRenamed("job_id", "doc_id")
    labelled = texts.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = skills.extract_skills(labelled, ["doc_id"], "text", dic)
    return matching.score_eval(found, labels, dic)


PAIR_KEYS = ["conv_id", "resume_turn"]


@register("pair_scores")
def q_pair_scores(spark, d):
    return matching.lexical_pair_scores(A.turn_pairs(spark, d), PAIR_KEYS)


@register("top_matches")
def q_top_matches(spark, d):
    e = read_table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return matching.top_matches(e.filter(F.col("label") == 0), e.filter(F.col("label") != 0),
                                TOP_MATCHES)


# ---- table maintenance ----------------------------------------------------------


def _closed_accounts(spark, d):
    """Users whose accounts are closed: customers with a negative balance."""
    return read_table(spark, d, "customer", "c_custkey", "c_acctbal").filter(
        F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))


@register("change_validation")
def q_change_validation(spark, d):
    return CH.apply_changes(A.applications(spark, d), A.change_sets(spark, d), AS_OF)[1]


@register("apply_changes")
def q_apply_changes(spark, d):
    return CH.apply_changes(A.applications(spark, d), A.change_sets(spark, d), AS_OF)[0]


@register("changes_written")
def q_changes_written(spark, d):
    """The change set applied to the stored table by copy-on-write, read back."""
    base = shared_path(spark, "applications")
    CH.create_table(A.applications(spark, d), base)
    CH.write_changes(spark, base, A.change_sets(spark, d), AS_OF)
    return versioned.read_version(spark, base)


@register("delete_propagation")
def q_delete_propagation(spark, d):
    """Every row of the account tables with what became of it: its keys afterwards, or why
    it went."""
    tables = A.account_tables(spark, d)
    keys = [CH.ForeignKey(*k) for k in FOREIGN_KEYS]
    left, gone = CH.propagate_deletes(tables, keys, A.account_deletes(spark, d))
    fks = ["user_id", "resume_id", "application_id"]

    def shape(name, df, because):
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in fks]
        return df.select(F.lit(name).alias("table_name"), "id", *cols, because.alias("deleted_because"))

    out = [shape(n, df, F.lit(None).cast("string")) for n, df in left.items()]
    out += [shape(n, df, F.col("because")) for n, df in gone.items()]
    return reduce(DataFrame.unionByName, out)


@register("cascade_delete")
def q_cascade_delete(spark, d):
    apps = A.applications(spark, d).select("id", "user_id")
    return CH.cascade_delete(apps, _closed_accounts(spark, d), "user_id")


@register("cascade_set_null")
def q_cascade_set_null(spark, d):
    child = A.analyses(spark, d).select("id", F.col("id").alias("application_id"))
    purged = A.applications(spark, d).filter(F.col("status") == "withdrawn").select(
        F.col("id").alias("application_id"))
    return CH.cascade_set_null(child, purged, "application_id")


@register("orphan_rows")
def q_orphan_rows(spark, d):
    apps = A.applications(spark, d).select("id", "user_id")
    return CH.orphans(apps, A.users(spark, d), "user_id", "ext_id")


@register("new_users")
def q_new_users(spark, d):
    seen = read_table(spark, d, "events", "user_id", "ts").select(F.col("user_id").alias("ext_id"), "ts")
    return CH.new_users(seen, A.users(spark, d))


# ---- streaming, encoder, CSV and file intake -----------------------------------


@register("stream_weekly_trends")
def q_stream_weekly_trends(spark, d):
    return weekly.stream_weekly_trends(spark, A.analyses(spark, d))


@register("stream_weekly_restarted")
def q_stream_weekly_restarted(spark, d):
    """The weekly stream stopped and started again for a second part of the analyses, its sink
    folded after each; equal to the batch job's table."""
    a = materialize(A.analyses(spark, d), "analyses")
    odd = F.col("id") % 2 == 1
    return weekly.stream_weekly_in_phases(spark, [a.filter(odd), a.filter(~odd)], weekly.backlog_lateness(a))


@register("stream_late_rows")
def q_stream_late_rows(spark, d):
    """Analyses as a stream in three parts, the last with rows of all years: closed weeks
    with their counts, once, and the rows that came after their week was closed."""
    a = materialize(A.analyses(spark, d), "analyses")
    held = F.col("id") % 17 == 4
    early = F.col("created_at") < F.lit("1997-01-01").cast("timestamp_ntz")
    out = closing.stream_in_phases(spark, [a.filter(~held & early), a.filter(~held & ~early), a.filter(held)])
    return closing.read_closing_weeks(spark, out)


@register("tfidf_vectors")
def q_tfidf_vectors(spark, d):
    return vectors.tfidf_vectors(_final(spark, d), "job_id", "clean_description", EMBEDDING_DIM)


@register("term_vectors")
def q_term_vectors(spark, d):
    w = term_vectors.term_weights(_final(spark, d), "job_id", "clean_description")
    return w.withColumn("weight", F.round("weight", 6))


@register("request_cosines")
def q_request_cosines(spark, d):
    """Every accepted request: cosine of its resume's and its posting's term vectors, with
    document frequencies over both kinds of text."""
    res = materialize(A.resumes(spark, d), "resumes")
    checked = matching.request_outcomes(A.analysis_requests(spark, d), res)
    asked = materialize(checked.filter(F.col("outcome") == matching.ACCEPTED), "requests")
    texts = (res.select(F.concat(F.lit("r"), "resume_id").alias("text_id"), F.col("raw_text").alias("text"))
             .unionByName(asked.select(F.concat(F.lit("q"), "request_id").alias("text_id"),
                                       F.col("jd_text").alias("text"))))
    found = materialize(term_vectors.text_vectors(texts, "text_id", "text"), "text-vectors")
    pairs = asked.select("request_id", F.concat(F.lit("r"), "resume_id").alias("resume"),
                         F.concat(F.lit("q"), "request_id").alias("posting"))
    of_resumes, of_postings = (found.filter(F.col("text_id").startswith(kind)) for kind in "rq")
    return term_vectors.vector_cosines(pairs, "resume", "posting", of_resumes, of_postings, "text_id").select(
        "request_id", "score", "percent")


@register("corpus_csv_roundtrip")
def q_corpus_csv_roundtrip(spark, d):
    """Writes the posting, tag and label tables as CSV, the postings with their six columns in
    the order they came in, reads them back with fixed schemas and the pandas missing-value
    rules, and runs the flagship query on them; the first row of a job is the one that stands
    first in the files."""
    base = shared_path(spark, "csv")
    came = A.postings(spark, d).orderBy("ingest", "job_id").select(*POSTINGS.names)
    csvio.write_csv(came, f"{base}/postings")
    csvio.write_csv(A.job_skills(spark, d), f"{base}/job_skills")
    csvio.write_csv(A.skills(spark, d), f"{base}/skills")
    posts = csvio.read_csv_records(spark, f"{base}/postings", POSTINGS).withColumnRenamed("position", "ingest")
    tags = csvio.read_csv(spark, f"{base}/job_skills", JOB_SKILLS, multi_line=False).withColumn(
        "skill_abr", F.col("skill_abr").cast("long"))
    labels = csvio.read_csv(spark, f"{base}/skills", SKILLS, multi_line=False).withColumn(
        "skill_abr", F.col("skill_abr").cast("long"))
    return corpus.category_top(corpus.corpus_final(posts, tags, labels))


def _resume_files(spark, d, path):
    """User turns as uploaded files; ``path`` gives a file's place without its suffix."""
    c = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text").filter(
        F.col("role") == "user")
    ext = (F.when(F.col("turn") == 0, ".docx").when(F.col("turn") == 2, ".DOCX")
           .when(F.col("turn") == 4, ".pdf").otherwise(".txt"))
    return intake.as_files(c.withColumn("path", F.concat(path, ext)), "path", "text")


@register("corpus_artefacts")
def q_corpus_artefacts(spark, d):
    """Writes the corpus table and metadata JSON, loads them back, returns the loaded
    metadata record."""
    def meta(written):
        return corpus.corpus_metadata(written, TRAINED_AT, EMBEDDING_MODEL, EMBEDDING_DIM, written=True)

    base = sinks.write_corpus_artefacts(_final(spark, d), meta, shared_path(spark, "artefacts"))
    loaded = sinks.load_corpus_artefacts(spark, base)[1]
    return loaded.withColumns({c: F.to_json(c) for c in sinks.NESTED})   # text, to compare


@register("corpus_vectors")
def q_corpus_vectors(spark, d):
    """The corpus written with a model's vector in every row, read back."""
    def meta(written):
        return corpus.corpus_metadata(written, TRAINED_AT, "letters", 26, written=True)

    final = encoder.encode(_final(spark, d), "clean_description", encoder.LetterModel)
    base = sinks.write_corpus_artefacts(final, meta, shared_path(spark, "artefacts"))
    return _rounded(sinks.load_corpus_artefacts(spark, base)[0])


def _rounded(vectors_):
    return vectors_.select("job_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@register("window_vectors")
def q_window_vectors(spark, d):
    """Vectors of a model that takes so many characters of a text."""
    return _rounded(encoder.encode(_final(spark, d), "clean_description", encoder.LetterModel, window=MODEL_CHARS))


@register("tenant_latest")
def q_tenant_latest(spark, d):
    """The newest application of every user and how many there are, from the tracker table
    in user buckets: no shuffle."""
    path = shared_path(spark, "tenant")
    t = tenant.write_user_table(A.applications(spark, d), "tenant_" + path[-12:], path)
    return t.groupBy("user_id").agg(
        F.max_by(F.struct("id", "created_at", "status"), F.struct("created_at", "id")).alias("r"),
        F.count(F.lit(1)).alias("applications")).select("user_id", "r.*", "applications")


@register("resume_intake_checks")
def q_resume_intake_checks(spark, d):
    path = F.concat(F.lit("upload/resume_"), F.col("conv_id").cast("string"), F.lit("_"),
                    F.col("turn").cast("string"))
    return intake.intake(_resume_files(spark, d, path)).drop("path")


@register("resume_append")
def q_resume_append(spark, d):
    """Every user names the files alike; the upload's path tells them apart."""
    path = F.concat(F.lit("upload/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
                    F.lit("/cv"))
    files = _resume_files(spark, d, path)
    sent = files.select("path", F.regexp_extract("path", r"upload/(\d+)/", 1).cast("long").alias("user_id"))
    return intake.resume_rows(intake.intake(files), sent, AS_OF)
