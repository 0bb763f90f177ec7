"""Corpus job: dedup, length filters, cleaning, label join, skill lists,
category frequencies, experience distribution, funnel counts and metadata.

Shape: one aggregation by job_id does dropna + keep-first + raw row counts (partial
aggregation map-side, so a job id holding a third of all rows is reduced before the
shuffle); the skill lists are a second aggregation by job_id, and the left join of the
two reuses that hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import clean_skill, iso_seconds, with_clean_text
from hirelens.operators.joins import join_dimension
from hirelens.session import materialize
from hirelens.schemas import (CATEGORY_FLOOR, CLEAN_MIN_CHARS, RAW_MIN_CHARS,
                              RETRAIN_THRESHOLD, TOP_CATEGORIES)

def keep_first(postings: DataFrame, key: str = "job_id", order: str = "ingest",
               required: tuple[str, ...] = ("description", "title")) -> DataFrame:
    """W1 + P5: drop rows missing ``required``, then keep the first row per ``key`` in
    ``order``. Also returns ``n_raw``: all rows of the key before dropna (for A8).

    ``min_by`` ignores rows whose ordering value is null, which is how the dropna is
    folded into the same aggregate. Rows of a key with equal ``order`` go by a hash of their
    values, so a retried task keeps the same one."""
    valid = F.lit(True)
    for c in required:
        valid = valid & F.col(c).isNotNull()
    cols = [c for c in postings.columns if c not in (key, order)]
    rank = F.struct(order, F.xxhash64(*cols).alias("tie"))
    first = F.min_by(F.struct(*cols), F.when(valid & F.col(order).isNotNull(), rank))
    return (postings.groupBy(key)
            .agg(first.alias("_r"), F.count(F.lit(1)).alias("n_raw"))
            .select(key, "n_raw", "_r.*")
            .withColumn("_kept", F.col("title").isNotNull() & F.col("description").isNotNull()))


def staged_postings(postings: DataFrame) -> DataFrame:
    """All dedup survivors with stage flags; cleaning runs only on rows that passed P6."""
    d = keep_first(postings)
    long_raw = d["_kept"] & (F.length("description") > RAW_MIN_CHARS)
    d = with_clean_text(d.withColumn("_long", long_raw), "description", "_cleaned",
                        only_if=F.col("_long"))
    # The generator is a barrier: without it the length filter moves below this projection
    # with a copy of the whole cleaning chain, and every text is cleaned twice.
    d = d.withColumn("clean_description", F.explode(F.array("_cleaned"))).drop("_cleaned")
    return d.withColumn("_clean", F.col("_long") & (F.length("clean_description") > CLEAN_MIN_CHARS))


def clean_postings(postings: DataFrame) -> DataFrame:
    """Postings that survive every text filter."""
    return staged_postings(postings).filter("_clean").drop("_kept", "_long", "_clean", "n_raw")


def skill_lists(job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """job_id -> sorted distinct cleaned category names.

    Nameless skills become '' (clean before dropna); only unmatched tags drop out."""
    labels = skills.select("skill_abr", clean_skill(F.col("skill_name")).alias("skill_name"))
    tagged = join_dimension(job_skills.filter(F.col("skill_abr").isNotNull()), labels, "skill_abr")
    return (tagged.groupBy("job_id")
            .agg(F.array_sort(F.collect_set("skill_name")).alias("skill_categories")))


def attach_skills(clean: DataFrame, lists: DataFrame) -> DataFrame:
    """Left join; postings without tags get []."""
    return (clean.join(lists, "job_id", "left")
            .withColumn("skill_categories",
                        F.coalesce("skill_categories", F.array().cast("array<string>"))))


def corpus_final(postings: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """The corpus table (one row per kept posting)."""
    return attach_skills(clean_postings(postings), skill_lists(job_skills, skills)).select(
        "job_id", "title", F.col("formatted_experience_level").alias("exp_level"),
        "clean_description", "skill_categories")


def category_counts(final: DataFrame, floor: int = CATEGORY_FLOOR) -> DataFrame:
    """A5 + P8: postings per category (lists are sets, so each posting counts once)."""
    return (final.select(F.explode("skill_categories").alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("postings"))
            .filter(F.col("postings") >= floor))


def category_top(final: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """Top-k categories; ties by name."""
    return category_counts(final).orderBy(F.desc("postings"), F.asc("category")).limit(k)


def experience_dist(final: DataFrame) -> DataFrame:
    """Experience-level distribution, missing levels dropped."""
    return (final.filter(F.col("exp_level").isNotNull())
            .groupBy("exp_level").agg(F.count(F.lit(1)).alias("postings")))


def corpus_funnel(postings: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """A8 + N7: stage row counts in one pass of conditional sums."""
    staged = attach_skills(staged_postings(postings), skill_lists(job_skills, skills))

    def n(cond):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")

    return staged.agg(
        F.coalesce(F.sum("n_raw"), F.lit(0)).cast("long").alias("raw_rows"),
        n(F.col("_kept")).alias("after_dedup"),
        n(F.col("_long")).alias("after_length"),
        n(F.col("_clean")).alias("after_cleaning"),
        n(F.col("_clean") & (F.size("skill_categories") > 0)).alias("with_tags"),
    )


def corpus_metadata(final: DataFrame, trained_at, embedding_model: str,
                    embedding_dim: int, written: bool = False) -> DataFrame:
    """S8 + A9: the one-row metadata record. Pieces are aggregated separately (each
    small: one count row, the top list, the level rows) and folded in one final agg.
    ``final`` feeds four of them, so it is materialised once (it is the corpus table
    the job writes anyway) instead of re-running the cleaning four times."""
    if not written:          # a table read back from files is already materialised
        final = materialize(final, "corpus-final")
    counts = category_counts(final)
    pieces = (
        final.agg(F.count(F.lit(1)).alias("n")).select(F.lit("jds").alias("kind"),
                                                        F.lit(None).cast("string").alias("key"), "n")
        .unionByName(counts.agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("cats").alias("kind"), F.lit(None).cast("string").alias("key"), "n"))
        .unionByName(category_top(final).select(F.lit("top").alias("kind"),
                                                F.col("category").alias("key"),
                                                F.col("postings").alias("n")))
        .unionByName(experience_dist(final).select(F.lit("lvl").alias("kind"),
                                                   F.col("exp_level").alias("key"),
                                                   F.col("postings").alias("n")))
    )
    kind = F.col("kind")
    top = F.transform(
        F.array_sort(F.collect_list(F.when(kind == "top", F.struct((-F.col("n")).alias("o"),
                                                                     F.col("key").alias("k"))))),
        lambda s: F.struct(s["k"].alias("name"), (-s["o"]).alias("count")))
    levels = F.map_from_entries(F.array_sort(F.collect_list(
        F.when(kind == "lvl", F.struct(F.col("key"), F.col("n"))))))
    return pieces.agg(
        iso_seconds(F.lit(trained_at).cast("timestamp_ntz")).alias("trained_at"),
        F.coalesce(F.sum(F.when(kind == "jds", F.col("n"))), F.lit(0)).cast("long").alias("total_jds"),
        F.coalesce(F.sum(F.when(kind == "cats", F.col("n"))), F.lit(0)).cast("long").alias("total_categories"),
        F.to_json(top).alias("top_categories"),
        F.to_json(levels).alias("exp_distribution"),
        F.lit(RETRAIN_THRESHOLD).alias("retrain_threshold"),
        F.lit(0).alias("analyses_since_retrain"),
        F.lit(embedding_model).alias("embedding_model"),
        F.lit(embedding_dim).alias("embedding_dim"),
    )
