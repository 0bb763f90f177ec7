"""Stand-ins: the driver's tables mapped onto the application's tables.

Every adapter is a lazy projection / join of the given tables, so its size grows with
them. The oracle SQL in ``hirelens.plans.oracle`` builds the same tables with the same
rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.operators.joins import join_dimension
from hirelens.schemas import STATUSES
from hirelens.sources.tables import read_table


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings with an ingest order. Labelled documents were scraped a second
    time (ingest 1, changed text), so the same job_id appears twice."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labelled = read_table(spark, sf_dir, "labels", "doc_id").distinct().withColumn("again", F.lit(1))
    # one join that both scrapes leave partitioned by job, so that texts are shuffled once
    scraped = docs.join(labelled, "doc_id", "left").select(
        "doc_id", "text", "lang", "source",
        F.explode(F.when(F.col("again") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ingest"))
    return scraped.select(
        F.col("doc_id").alias("job_id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.when(F.col("ingest") == 0, F.col("text"))
        .otherwise(F.concat(F.col("text"), F.lit("\nReposted listing."))).alias("description"),
        F.col("source").alias("company_name"),
        F.col("lang").alias("formatted_experience_level"),
        F.lit(None).cast("string").alias("location"),
        "ingest",
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill label map: skill_abr -> skill_name."""
    return read_table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        F.col("p_partkey").alias("skill_abr"), F.col("p_name").alias("skill_name"))


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, skill_abr) tags; a job may carry the same tag more than once."""
    return read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_abr"))


def _level(priority: Column) -> Column:
    return (F.when(priority == "1-URGENT", "mid_level")
            .when(priority == "2-HIGH", "early_career")
            .when(priority == "3-MEDIUM", "student")
            .when(priority == "5-LOW", "fresher"))          # '4-NOT SPECIFIED' -> absent


def analyses(spark: SparkSession, sf_dir: str, newest: int | None = None) -> DataFrame:
    """Stored analyses: one per order; required_skills = the order's skill names as
    the model returned them (the first line's skill in upper case), distinct, sorted.

    ``newest`` is for the feature that reads the latest analyses of all users only: it
    picks them before the line items are joined (lists are never null here, so the
    null-list filter removes none of them)."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                        "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    if newest is not None:
        orders = orders.orderBy(F.desc("o_orderdate"), F.asc("o_orderkey")).limit(newest)
        li = li.join(F.broadcast(orders.select(F.col("o_orderkey").alias("l_orderkey"))),
                     "l_orderkey", "left_semi")       # at most ``newest`` keys
    names = join_dimension(li, skills(spark, sf_dir).withColumnRenamed("skill_abr", "l_partkey"),
                           "l_partkey")
    raw = F.when(F.col("l_linenumber") == 1, F.upper("skill_name")).otherwise(F.col("skill_name"))
    lists = (names.groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_set(raw)).alias("required_skills")))
    return (orders.join(lists, orders.o_orderkey == lists.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("created_at"),
                    F.coalesce("required_skills", F.array().cast("array<string>"))
                    .alias("required_skills"),
                    _level(F.col("o_orderpriority")).alias("level")))


def _order_texts(spark: SparkSession, sf_dir: str, line: Column, only: Column | None = None) -> DataFrame:
    """order_id, lines: one text line per line item of an order, in line order; ``line``
    is an expression over p_name and l_linenumber. An order has a handful of line items,
    so its text stays small."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    if only is not None:
        li = li.filter(only)
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.struct("l_linenumber", line.alias("line")).alias("item"))
    return rows.groupBy("order_id").agg(
        F.array_join(F.array_sort(F.collect_list("item")).getField("line"), "\n").alias("lines"))


def _posting_line() -> Column:
    """Every third line item is an optional skill, the rest are asked for."""
    wish = F.col("l_linenumber") % 3 == 0
    return F.when(wish, F.concat(F.lit("Nice to have: "), F.col("p_name"))).otherwise(
        F.concat(F.lit("Must know "), F.upper(F.col("p_name")), F.lit(".")))


def posting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole posting texts with skill lines: every document, followed by a title line, a
    company line and the lines of the order that has its id."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    lines = _order_texts(spark, sf_dir, _posting_line())
    text = F.concat_ws("\n", F.col("text"), F.concat_ws(" ", F.lit("Title:"), "lang", "source"),
                       F.concat_ws(" ", F.lit("Company:"), "source"), F.col("lines"))
    return docs.join(lines, docs.doc_id == lines.order_id, "left").select(
        F.col("doc_id").alias("job_id"), text.alias("text"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes: one per order, of its customer, naming the skills of the line items that
    were not returned."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = _order_texts(spark, sf_dir, F.concat(F.lit("Built a "), F.col("p_name"), F.lit(", alone.")),
                         F.col("l_returnflag") != "R")
    return o.join(lines, o.o_orderkey == lines.order_id, "left").select(
        F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("user_id"),
        F.concat_ws("\n", F.lit("Experience"), F.col("lines")).alias("raw_text"))


def analysis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to score a resume against a posting text: one per order, level from its
    priority. Some lack the resume id, name one that does not exist or belongs to another
    user, or carry a blank text; pending orders have no application."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderpriority")
    lines = _order_texts(spark, sf_dir, _posting_line())
    k = F.col("o_orderkey")
    text = F.concat_ws("\n", F.concat(F.lit("Role: engineer "), F.col("o_orderstatus")),
                       F.concat(F.lit("Company: house "), F.col("o_orderpriority")), F.col("lines"))
    return o.join(lines, o.o_orderkey == lines.order_id, "left").select(
        k.alias("request_id"),
        F.when(k % 17 == 5, F.lit(None)).when(k % 23 == 7, -1 - k).otherwise(k).alias("resume_id"),
        (F.col("o_custkey") + F.when(k % 13 == 3, 1).otherwise(0)).alias("user_id"),
        F.when(F.col("o_orderstatus") != "P", k).alias("application_id"),
        F.when(k % 11 == 4, F.lit(" \n")).otherwise(text).alias("jd_text"),
        _level(F.col("o_orderpriority")).alias("level"))


def _status(st: Column, pr: Column) -> Column:
    return (F.when(st == "F", F.when(pr.isin("1-URGENT", "2-HIGH"), "offer").otherwise("rejected"))
            .when(st == "O", F.when(pr == "1-URGENT", "interview")
                  .when(pr == "2-HIGH", "screening").otherwise("applied"))
            .otherwise(F.when(pr == "5-LOW", "withdrawn").otherwise("saved")))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker rows: one application per order. Saved ones have no applied_date."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderdate", "o_orderpriority")
    status = _status(F.col("o_orderstatus"), F.col("o_orderpriority"))
    ts = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("company"),
        F.concat(F.lit("role "), F.col("o_orderstatus")).alias("role"),
        status.alias("status"),
        F.when(status != "saved", F.to_date(ts)).alias("applied_date"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("notes"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered users: customers in good standing; ext_id is the sign-in id."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    return c.filter(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("ext_id"),
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("id"),
        F.col("c_name").alias("full_name"))


def account_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that hang on user accounts, with their keys. An analysis belongs to its
    order's customer and names the resume of an order up to six before, if there is one, and the
    order's application, unless it is pending; refresh tokens are the sign-in events."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    near = k - k % 7
    own = o.select(k.alias("id"), F.col("o_custkey").alias("user_id"), "o_orderstatus",
                   F.when(near > 0, near).alias("_near"))
    ids = o.select(k.alias("resume_id"))
    linked = own.join(ids, F.col("_near") == F.col("resume_id"), "left")
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return {
        "users": read_table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("id")),
        "applications": own.select("id", "user_id"),
        "resumes": own.select("id", "user_id"),
        "analyses": linked.select("id", "user_id", "resume_id",
                                  F.when(F.col("o_orderstatus") != "P", F.col("id")).alias("application_id")),
        "refresh_tokens": ev.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("id"), "user_id"),
    }


def account_deletes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What is asked to be deleted: closed accounts, withdrawn applications, some resumes."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    return {
        "users": c.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id")),
        "applications": applications(spark, sf_dir).filter(F.col("status") == "withdrawn").select("id"),
        "resumes": o.filter(F.col("o_orderkey") % 19 == 3).select(F.col("o_orderkey").alias("id")),
    }


PATCH_STATUS_CHOICES = STATUSES + ["hired"]     # 'hired' is outside the domain


def change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk change set for the tracker: (seq, op, id, user_id, fields).

    signup -> insert under a new id; error -> delete; purchase -> patch status and date;
    click -> patch notes; view -> patch of a field that may not be patched. Three events
    share one target id. Low-value events (< 10) come from the event's own account,
    the rest from the target's owner."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value",
                    "props")
    owners = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    target = F.floor(F.col("event_id") / 3).cast("long")
    ev = ev.withColumn("target", target)
    ev = ev.join(owners, ev.target == owners.o_orderkey, "left")
    et = F.col("event_type")
    op = F.when(et == "signup", "insert").when(et == "error", "delete").otherwise("patch")
    cid = F.when(et == "signup", -(F.col("event_id") + 1)).otherwise(F.col("target"))
    actor = F.when((F.col("value") < 10) | F.col("o_custkey").isNull(), F.col("user_id")) \
        .otherwise(F.col("o_custkey"))
    choice = F.element_at(F.array(*[F.lit(s) for s in PATCH_STATUS_CHOICES]),
                          (F.floor(F.col("value")) % len(PATCH_STATUS_CHOICES) + 1).cast("int"))
    company = F.when(F.col("value") < 5, F.lit(" ")).otherwise(
        F.concat(F.lit("Company "), F.col("user_id").cast("string")))
    fields = (
        F.when(et == "signup", F.create_map(F.lit("company"), company, F.lit("role"), F.lit("Engineer"),
                                            F.lit("notes"), F.col("props")))
        .when(et == "purchase", F.create_map(F.lit("status"), choice, F.lit("applied_date"),
                                             F.date_format("ts", "yyyy-MM-dd")))
        .when(et == "click", F.create_map(F.lit("notes"), F.col("props")))
        .when(et == "view", F.create_map(F.lit("viewed_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return ev.select(F.col("event_id").alias("seq"), op.alias("op"), cid.alias("id"),
                     actor.alias("user_id"), fields.alias("fields"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model reply texts: bare, fenced, broken and non-object variants of events.props."""
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "props")
    p, et = F.col("props"), F.col("event_type")
    raw = (F.when(et == "click", F.concat(F.lit("  "), p, F.lit("\n")))
           .when(et == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
           .when(et == "purchase", F.concat(F.lit("```\n"), p, F.lit("\n```\n")))
           .when(et == "signup", F.concat(p, F.lit(" junk")))
           .otherwise(F.concat(F.lit("["), p, F.lit("]"))))
    return ev.select("event_id", raw.alias("raw"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resume, posting) text pairs: a user turn and the assistant turn that answers it
    in the same conversation (equi-join on conv_id, turn + 1)."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    res = c.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("resume_turn"), F.col("text").alias("resume_text"))
    post = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("resume_turn"), F.col("text").alias("jd_text"))
    return res.join(post, ["conv_id", "resume_turn"], "inner")
