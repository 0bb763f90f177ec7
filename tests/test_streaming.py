"""Structured Streaming weekly counts: Monday windows, late rows, batch = stream."""

import time

from pyspark.sql import functions as F

from hirelens.operators import trends
from hirelens.sources import adapters as A
from hirelens.streaming import weekly

SCHEMA = "id long, created_at string, required_skills array<string>"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))


def test_monday_window_and_late_rows(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    _rows(spark, [(1, "2024-01-07 10:00:00", ["sql"]), (2, "2024-03-01 00:00:00", ["sql", "go"])]) \
        .coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)
    _rows(spark, [(4, "2024-03-02 00:00:00", ["go"])]).coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)
    # Late: older than (max event time - 7 days). Spark filters late input with the
    # watermark of the previous batch, so it is dropped from the third batch on.
    _rows(spark, [(3, "2024-01-08 00:00:00", ["rust"])]).coalesce(1).write.mode("append").parquet(src)
    out = weekly.run_weekly_stream(spark, src, max_files=1)
    got = {(r.skill_name, str(r.week_of)): (r.frequency, r.source_count)
           for r in weekly.read_weekly_table(spark, out).collect()}
    assert got[("sql", "2024-01-01")] == (1, 1)         # Sunday 2024-01-07 -> Monday 2024-01-01
    assert ("rust", "2024-01-08") not in got            # late row dropped by the watermark
    assert got[("go", "2024-02-26")] == (2, 2)


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    a = A.analyses(spark, d)
    s = weekly.stream_weekly_trends(spark, a)
    b = trends.weekly_trends(a)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_late_rows_are_counted_and_lateness_from_the_data_keeps_them(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    for i, day in enumerate(["2024-03-01", "2024-03-02", "2024-01-08"]):
        _rows(spark, [(i, f"{day} 00:00:00", ["go"])]).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out = weekly.run_weekly_stream(spark, src, max_files=1)
    assert weekly.late_rows(spark, src, out).first().asDict() == {"analyses": 3, "counted": 2, "late": 1}
    lateness = weekly.backlog_lateness(spark.read.parquet(src))
    out = weekly.run_weekly_stream(spark, src, max_files=1, lateness=lateness)
    assert weekly.late_rows(spark, src, out).first().late == 0


def test_restart_resumes_and_empty_source(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    _rows(spark, []).write.parquet(src)
    weekly.run_weekly_stream(spark, src, out=out, ckpt=ckpt)
    assert weekly.read_weekly_table(spark, out).count() == 0
    for i in (1, 2):
        _rows(spark, [(i, "2024-03-01 00:00:00", ["go", None]), (9 + i, "2024-03-01 00:00:00", None)]) \
            .coalesce(1).write.mode("append").parquet(src)
        weekly.run_weekly_stream(spark, src, out=out, ckpt=ckpt)
        row = weekly.read_weekly_table(spark, out).first()
        assert (row.skill_name, row.frequency, row.source_count) == ("go", i, 2 * i)


def test_weekly_trends_reads_lists_given_as_json_text(spark):
    a = _rows(spark, [(1, "2024-03-01 00:00:00", ["SQL ", "go"]), (2, "2024-03-01 00:00:00", None)])
    text = a.withColumn("required_skills", F.to_json("required_skills"))
    want = {("sql", 1, 2), ("go", 1, 2)}
    for df in (a, text):
        assert {(r.skill_name, r.frequency, r.source_count)
                for r in trends.weekly_trends(df).collect()} == want


def test_folded_sink_keeps_the_newest_counts_and_leaves_old_batches_unread(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    for i in (1, 2, 3):
        _rows(spark, [(i, "2024-03-01 00:00:00", ["go"]), (9 + i, "2024-03-02 00:00:00", None)]) \
            .coalesce(1).write.mode("append").parquet(src)
        weekly.run_weekly_stream(spark, src, out=out, ckpt=ckpt)
        before = weekly.read_weekly_table(spark, out).collect()
        last = weekly.compact_weekly_table(spark, out)
        assert last == weekly.compact_weekly_table(spark, out)
        table = weekly.read_weekly_table(spark, out)
        assert table.collect() == before and (before[0].frequency, before[0].source_count) == (i, 2 * i)
        assert f"/compact/upto={last}" in table._jdf.queryExecution().executedPlan().toString()
    assert weekly.late_rows(spark, src, out).first().asDict() == {"analyses": 6, "counted": 6, "late": 0}
    # a replay of a folded batch, and a fold that was not published, change nothing
    stale = spark.read.schema(weekly.SINK).parquet(f"{out}/compact/upto={last}").withColumn("n", F.lit(77).cast("long"))
    stale.write.mode("overwrite").parquet(f"{out}/batches/batch_id=0")
    stale.write.mode("overwrite").parquet(f"{out}/compact/upto={last + 1}")
    assert weekly.read_weekly_table(spark, out).collect() == before
