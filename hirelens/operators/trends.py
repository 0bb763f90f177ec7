"""Skill trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.functions.text import clean_skill, week_monday
from hirelens.schemas import RECENT_ANALYSES, RETRAIN_THRESHOLD, SHOWN_TRENDS
from hirelens.session import materialize
from hirelens.sources import versioned

TREND_KEYS = ["skill_name", "week_of"]


def skill_array(df: DataFrame, name: str) -> Column:
    """A list column that arrives as JSON text is decoded; arrays pass through."""
    if dict(df.dtypes)[name] == "string":
        return F.from_json(F.col(name), "array<string>")
    return F.col(name)


def cleaned_list(c: Column) -> Column:
    """F2 on every element; blank names dropped."""
    return F.filter(F.transform(c, clean_skill), lambda s: s != "")


def recent_skill_counts(analyses: DataFrame, last_n: int = RECENT_ANALYSES,
                        k: int = SHOWN_TRENDS) -> DataFrame:
    """Skill frequency over the newest ``last_n`` analyses of all
    users (every occurrence counts), top ``k`` by count then name.

    The limit is the feature (the reference's LIMIT 100); it plans as
    TakeOrderedAndProject: a per-partition top-n, then one merge of n * partitions rows."""
    recent = (analyses.filter(F.col("required_skills").isNotNull())
              .orderBy(F.desc("created_at"), F.asc("id")).limit(last_n))
    skills = skill_array(recent, "required_skills")
    return (recent.select(F.explode(cleaned_list(skills)).alias("skill"))
            .groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("skill")).limit(k))


def weekly_counts(analyses: DataFrame) -> DataFrame:
    """(week_of, skill_name, n, total): analyses of a Monday week that name a skill,
    once each, and in the row without a skill (``total``) all analyses of the week."""
    exploded = analyses.select(
        week_monday(F.col("created_at")).alias("week_of"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")),
                           F.array_distinct(F.coalesce(
                               cleaned_list(skill_array(analyses, "required_skills")),
                               F.array().cast("array<string>"))))).alias("skill_name"))
    # ``total`` is a result of the aggregate, so a filter on it stays above: both readers of
    # the counts share one shuffle, and the analyses are read once
    return exploded.groupBy("week_of", "skill_name").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("skill_name").isNull()).alias("total"))


def weekly_trends(analyses: DataFrame) -> DataFrame:
    """A10: per (skill, Monday week): analyses naming the skill (once each) and all analyses
    that week. The totals, a row per week, are joined to the skills' rows, so a week's
    skills need not meet in one task."""
    return trends_of(weekly_counts(analyses))


def trends_of(counts: DataFrame) -> DataFrame:
    """The weekly table of (week_of, skill_name, n, total) rows. A null week is a week of
    its own."""
    total = (counts.filter("total")
             .select(F.col("week_of").alias("_week"), F.col("n").alias("source_count")))
    return (counts.filter(~F.col("total"))
            .join(total, F.col("week_of").eqNullSafe(F.col("_week")))
            .select("skill_name", "week_of", F.col("n").alias("frequency"), "source_count"))


# ---- C8 + A10 kept up to date --------------------------------------------------------------

COUNTS_ORDER = ["week_of", "skill_name"]


def _week_part() -> Column:
    return F.coalesce(F.col("week_of").cast("string"), F.lit("none"))


def create_weekly_counts(analyses: DataFrame, base: str) -> int:
    """Version 0 of the stored weekly counts, a part per week. The totals are stored too: a
    week may hold analyses that name no skill."""
    return versioned.create(weekly_counts(analyses), base, _week_part(), COUNTS_ORDER)


def count_deltas(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(week_of, skill_name, n, total) with signed n: what the counts gain and lose when the
    analyses ``removed`` go and ``added`` come; a changed analysis is in both."""
    lost = weekly_counts(removed).withColumn("n", -F.col("n"))
    both = weekly_counts(added).unionByName(lost)
    return (both.groupBy("week_of", "skill_name").agg(F.sum("n").cast("int").alias("n"), F.max("total").alias("total"))
            .filter(F.col("n") != 0))


def apply_deltas(spark: SparkSession, base: str, removed: DataFrame, added: DataFrame) -> list[str]:
    """Bring the stored counts up to date without reading the other analyses: the weeks that
    gain or lose something are read, summed with their deltas and written as the next
    version; counts that reach 0 go. Returns those weeks. A count below 0 means that rows
    were removed which were never counted: an error, and the stored version stays."""
    deltas = materialize(count_deltas(removed, added), "trend-deltas")
    weeks = sorted(r.w for r in deltas.select(_week_part().alias("w")).distinct().collect())
    stored = versioned.read_version(spark, base, only=weeks)
    n = F.sum("n")
    new = (stored.unionByName(deltas).groupBy("week_of", "skill_name")
           .agg(F.when(n < 0, F.raise_error(F.lit("an analysis was removed that was not counted")))
                .otherwise(n).cast("int").alias("n"), F.max("total").alias("total"))
           .filter(F.col("n") != 0))
    if weeks:
        versioned.replace_parts(new, base, _week_part(), COUNTS_ORDER, weeks)
    return weeks


def rising_skills(trends: DataFrame) -> DataFrame:
    """Week-over-week change per skill over the weeks present. A skill's window holds
    one row per week, so it is bounded by the time span, not by the data volume."""
    w = Window.partitionBy("skill_name").orderBy("week_of")
    prev = F.lag("frequency").over(w)
    return trends.select("skill_name", "week_of", "frequency", prev.alias("prev_frequency"),
                         (F.col("frequency") - prev).alias("delta"))


def rising_skills_calendar(trends: DataFrame) -> DataFrame:
    """W3, calendar variant: every Monday between a skill's first and last week is
    present (a missing week counts 0), so the change is week over calendar week. A row fills
    the weeks up to the skill's next one; a skill's window is bounded by the time span."""
    w = Window.partitionBy("skill_name").orderBy("week_of")
    upto = F.coalesce(F.date_sub(F.lead("week_of").over(w), 7), F.col("week_of"))
    filled = (trends.select("skill_name", F.col("week_of").alias("_own"), F.col("frequency").alias("_n"), upto.alias("_upto"))
              .select("skill_name", "_own", "_n", F.explode(F.sequence("_own", "_upto", F.expr("INTERVAL 1 WEEK"))).alias("week_of"))
              .withColumn("frequency", F.when(F.col("week_of") == F.col("_own"), F.col("_n")).otherwise(0)))
    return rising_skills(filled)


def trend_feed(corpus_top: DataFrame, user_top: DataFrame, k: int = SHOWN_TRENDS) -> DataFrame:
    """Both lists in one table with a source tag and rank (each list <= 30 rows)."""
    ml = corpus_top.select(F.lit("ml_trends").alias("source"), F.col("category").alias("skill"),
                           F.col("postings").alias("n"))
    user = user_top.select(F.lit("user_trends").alias("source"), "skill", "n")
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.asc("skill"))
    return (ml.unionByName(user).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def retrain_check(analyses: DataFrame, since: int = 0,
                  threshold: int = RETRAIN_THRESHOLD) -> DataFrame:
    """(analyses - analyses_since_retrain) >= threshold."""
    n = F.count(F.lit(1))
    return analyses.agg(n.alias("analyses"), F.lit(since).alias("since"),
                        F.lit(threshold).alias("threshold"),
                        ((n - F.lit(since)) >= F.lit(threshold)).alias("should_retrain"))


def retrain_check_from_metadata(analyses: DataFrame, metadata: DataFrame) -> DataFrame:
    """A11 with the threshold and baseline read from the stored metadata record (one row,
    two integers; defaults 50 and 0 as in the reference when a key is missing)."""
    m = metadata.select("retrain_threshold", "analyses_since_retrain").first()
    threshold = RETRAIN_THRESHOLD if m is None or m[0] is None else int(m[0])
    since = 0 if m is None or m[1] is None else int(m[1])
    return retrain_check(analyses, since=since, threshold=threshold)


def upsert(base: DataFrame, new: DataFrame, keys: list[str] = TREND_KEYS) -> DataFrame:
    """Latest wins on the unique key: keep base rows the batch does not touch."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)
