"""Weekly counts kept up to date, and the weekly plan reading its analyses once."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hirelens.operators import trends
from hirelens.sources import versioned

D = "/root/testdata/sf0.001"


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, created_at string, required_skills array<string>").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))


def _table(df):
    return {(r.skill_name, str(r.week_of)): (r.frequency, r.source_count) for r in df.collect()}


def _random(rng, i):
    day = None if rng.random() < 0.05 else f"2024-01-{rng.randint(1, 28):02d} 10:00:00"
    skills = rng.choice([None, [], ["sql"], ["SQL ", "sql", "go"], ["go", None, " "], ["r", "go"]])
    return (i, day, skills)


@pytest.mark.parametrize("seed", range(3))
def test_deltas_equal_a_full_computation(spark, tmp_dir, seed):
    rng = random.Random(seed)
    now = {i: _random(rng, i) for i in range(60)}
    base = f"{tmp_dir}/counts{seed}"
    trends.create_weekly_counts(_frame(spark, list(now.values())), base)
    for step in (1, 2):
        removed, added = [], []
        for i in rng.sample(sorted(now), 15):
            removed.append(now.pop(i))
            if rng.random() < 0.5:
                added.append(_random(rng, i))
        added += [_random(rng, 1000 * step + k) for k in range(5)]
        now |= {r[0]: r for r in added}
        trends.apply_deltas(spark, base, _frame(spark, removed), _frame(spark, added))
        want = _table(trends.weekly_trends(_frame(spark, list(now.values()))))
        assert _table(trends.trends_of(versioned.read_version(spark, base))) == want and want


def test_only_touched_weeks_are_rewritten(spark, tmp_dir):
    rows = [(1, "2024-01-02 00:00:00", ["go"]), (2, "2024-01-09 00:00:00", ["go"]), (3, "2024-01-16 00:00:00", [])]
    base = f"{tmp_dir}/counts"
    trends.create_weekly_counts(_frame(spark, rows), base)
    assert set(versioned.parts(spark, base)) == {"2024-01-01", "2024-01-08", "2024-01-15"}
    weeks = trends.apply_deltas(spark, base, _frame(spark, rows[1:2]), _frame(spark, [(9, "2024-01-17 00:00:00", ["r"])]))
    assert weeks == ["2024-01-08", "2024-01-15"]
    assert versioned.parts(spark, base) == {"2024-01-01": 0, "2024-01-15": 1}
    assert _table(trends.trends_of(versioned.read_version(spark, base))) == {
        ("go", "2024-01-01"): (1, 1), ("r", "2024-01-15"): (1, 2)}    # the total counts the one without skills
    # a change that cancels out touches nothing
    same = _frame(spark, rows[:1])
    assert trends.apply_deltas(spark, base, same, same) == [] and versioned.versions(spark, base) == [0, 1]


def test_removing_what_was_never_counted_is_an_error(spark, tmp_dir):
    base = f"{tmp_dir}/counts"
    trends.create_weekly_counts(_frame(spark, [(1, "2024-01-02 00:00:00", ["go"])]), base)
    with pytest.raises(Exception, match="not counted"):
        trends.apply_deltas(spark, base, _frame(spark, [(2, "2024-01-02 00:00:00", ["r"])]), _frame(spark, []))
    assert versioned.versions(spark, base) == [0]


def _scans(df):
    """File scans of the plan as it was executed; a reused shuffle has none of its own."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan =="):plan.index("== Initial Plan ==")]
    return len(re.findall(r"FileScan parquet", final)), "ReusedExchange" in final


@pytest.mark.parametrize("name,most", [("weekly_trends", 3), ("rising_skills", 3), ("rising_skills_calendar", 3), ("trend_upsert", 6)])
def test_analyses_are_read_once(spark, name, most):
    scans, reused = _scans(E.queries()[name](spark, D))
    assert scans <= most and reused
