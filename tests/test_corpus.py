"""Corpus job rules on small hand-made tables (FIXTURES §3.3)."""

from pyspark.sql import functions as F

from hirelens.operators import corpus, trends

LONG = "word " * 60          # > 200 raw chars, > 100 after cleaning


def _posting(spark, rows):
    return spark.createDataFrame(
        rows, "job_id long, title string, description string, company_name string, "
              "formatted_experience_level string, location string, ingest int")


def test_nameless_skill_and_untagged_posting(spark):
    posts = _posting(spark, [(1, "t", LONG, "c", "x", None, 0), (2, "t", LONG, "c", None, None, 0)])
    tags = spark.createDataFrame([(1, 10), (1, 11)], "job_id long, skill_abr long")
    labels = spark.createDataFrame([(10, None)], "skill_abr long, skill_name string")
    final = {r.job_id: r.skill_categories for r in corpus.corpus_final(posts, tags, labels).collect()}
    assert final == {1: [""], 2: []}


def test_keep_first_by_ingest_after_dropna(spark):
    posts = _posting(spark, [(1, None, LONG, "c", "x", None, 0), (1, "second", LONG, "c", "x", None, 1),
                             (2, "a", LONG, "c", "x", None, 1), (2, "b", LONG, "c", "x", None, 0)])
    kept = {r.job_id: r.title for r in corpus.keep_first(posts).filter("_kept").collect()}
    assert kept == {1: "second", 2: "b"}


def test_floor_and_tie_at_cutoff(spark):
    rows = [(i, [f"s{i % 3}"] if i < 29 else ["rare"]) for i in range(30)]
    final = spark.createDataFrame(rows, "job_id long, skill_categories array<string>")
    counts = {r.category: r.postings for r in corpus.category_counts(final).collect()}
    assert counts == {"s0": 10, "s1": 10}          # s2 has 9, rare has 1
    top = [r.category for r in corpus.category_top(final, k=1).collect()]
    assert top == ["s0"]                            # tie broken by name


def test_repeated_skill_counts(spark):
    a = spark.createDataFrame([(1, "2024-01-02 00:00:00", ["SQL", "sql ", " "])],
                              "id long, created_at string, required_skills array<string>") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    recent = {r.skill: r.n for r in trends.recent_skill_counts(a).collect()}
    assert recent == {"sql": 2}
    weekly = trends.weekly_trends(a).collect()
    assert [(r.skill_name, r.frequency, r.source_count) for r in weekly] == [("sql", 1, 1)]


def test_retrain_threshold(spark):
    for n, want in [(49, False), (50, True)]:
        a = spark.range(n).withColumnRenamed("id", "x")
        assert trends.retrain_check(a).first().should_retrain is want


def test_retrain_from_metadata(spark):
    meta = spark.createDataFrame([(5, 3)], "retrain_threshold int, analyses_since_retrain int")
    a = spark.range(8)
    r = trends.retrain_check_from_metadata(a, meta).first()
    assert (r.analyses, r.since, r.threshold, r.should_retrain) == (8, 3, 5, True)
    empty = spark.createDataFrame([], "retrain_threshold int, analyses_since_retrain int")
    assert trends.retrain_check_from_metadata(spark.range(49), empty).first().should_retrain is False


def test_keep_first_breaks_ties_by_value(spark):
    rows = [(1, "t", d, 0) for d in "abcdef"]
    kept = {corpus.keep_first(spark.createDataFrame(rows[k:] + rows[:k], "job_id long, title string, "
                                                    "description string, ingest int").repartition(3))
            .first().description for k in range(4)}
    assert len(kept) == 1


def test_broadcast_bound_counts_bytes(spark):
    from hirelens.operators.joins import is_small
    df = spark.createDataFrame([(i, "x" * 1000, [1, 2], None) for i in range(50)],
                               "id long, `note.text` string, l array<int>, n string")
    assert is_small(df) and not is_small(df, max_rows=49) and not is_small(df, max_bytes=50_000)
    assert is_small(df.limit(0), max_rows=0)
