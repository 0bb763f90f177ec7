"""Snapshot / JSON sinks, bound-parameter tenant reads, JSON-text skill lists."""

import json
import os

from pyspark.sql import functions as F

from hirelens.operators import trends
from hirelens.sources import sinks


def test_snapshot_and_json(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "id long, s string, x double")
    p = sinks.write_snapshot(df, os.path.join(tmp_dir, "v1"))
    assert spark.read.parquet(p).count() == 2
    j = sinks.write_json_records(df, os.path.join(tmp_dir, "json"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(j).collect()), key=lambda d: d["id"])
    assert rows == [{"id": 1, "s": "a"}, {"id": 2, "s": "b", "x": 0.5}]


def test_rows_of_user_binds_parameters(spark):
    spark.createDataFrame([(1, "applied"), (1, "offer"), (2, "offer")], "user_id long, status string") \
        .createOrReplaceTempView("apps_t")
    assert sinks.rows_of_user(spark, "apps_t", 1).count() == 2
    assert sinks.rows_of_user(spark, "apps_t", 1, "offer").count() == 1
    # a bound value is data, never SQL text
    assert sinks.rows_of_user(spark, "apps_t", 1, "offer' OR '1'='1").count() == 0


def test_skill_list_as_json_text(spark):
    df = spark.createDataFrame([(1, "2024-01-02 00:00:00", '["SQL", " go"]')],
                               "id long, created_at string, required_skills string")
    got = {r.skill: r.n for r in trends.recent_skill_counts(df).collect()}
    assert got == {"sql": 1, "go": 1}


def test_metadata_record_is_nested_json(spark, tmp_dir):
    from hirelens.operators.corpus import corpus_metadata
    final = spark.createDataFrame([(i, "x", ["sql", "go"][: 1 + i % 2]) for i in range(24)],
                                  "job_id long, exp_level string, skill_categories array<string>")
    base = sinks.write_corpus_artefacts(final, corpus_metadata(final, "2024-06-03 09:30:00", "m", 4), f"{tmp_dir}/art")
    record = json.loads(spark.read.text(f"{base}/metadata").first()[0])
    assert record["top_categories"] == [{"name": "sql", "count": 24}, {"name": "go", "count": 12}]
    assert record["exp_distribution"] == {"x": 24}
    loaded = sinks.load_corpus_artefacts(spark, base)[1].first()
    assert loaded.top_categories[1]["count"] == 12
    assert loaded.exp_distribution == {"x": 24}
