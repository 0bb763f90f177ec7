"""Target table schemas and domain constants."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values that must equal the application's rules -----------------
# Application status domain, in pipeline order; 'withdrawn' last.
STATUSES = ["saved", "applied", "screening", "interview", "offer", "rejected", "withdrawn"]
# Candidate levels accepted by the match analysis; absent level means 'fresher'.
LEVELS = ["fresher", "student", "early_career", "mid_level"]
DEFAULT_LEVEL = "fresher"
DEFAULT_STATUS = "applied"
# Fields a patch may change.
PATCH_FIELDS = ["company", "role", "status", "applied_date", "source_url", "notes"]
# Corpus job rules.
RAW_MIN_CHARS = 200        # keep descriptions longer than this (raw)
CLEAN_MIN_CHARS = 100      # keep cleaned descriptions longer than this
CATEGORY_FLOOR = 10        # keep categories seen in at least this many postings
TOP_CATEGORIES = 30        # stored top list
SHOWN_TRENDS = 20          # shown in the trend feed
RECENT_ANALYSES = 100      # trend input: latest analyses of all users
RETRAIN_THRESHOLD = 50     # new analyses that trigger a retrain
EXPECTED_PERCENT = 60      # hand-noted expected match of the check script
# Foreign keys: (child, column, parent, rows of a deleted parent go too).
FOREIGN_KEYS = [
    ("applications", "user_id", "users", True),
    ("resumes", "user_id", "users", True),
    ("analyses", "user_id", "users", True),
    ("analyses", "resume_id", "resumes", False),
    ("analyses", "application_id", "applications", False),
    ("refresh_tokens", "user_id", "users", True),
]
# ---------------------------------------------------------------------------

POSTINGS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("formatted_experience_level", T.StringType()),
    T.StructField("location", T.StringType()),
])

JOB_SKILLS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("skill_abr", T.StringType()),
])

SKILLS = T.StructType([
    T.StructField("skill_abr", T.StringType()),
    T.StructField("skill_name", T.StringType()),
])

APPLICATIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("applied_date", T.DateType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),          # insert | patch | delete
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])

SUGGESTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("priority", T.StringType()),
])
