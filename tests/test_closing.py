"""Weeks closed once, late rows as rows of the stream, compaction of the sink."""

import glob

from hirelens.streaming import closing
from tests.test_streaming import _rows


def _phase(spark, src, rows):
    _rows(spark, rows).coalesce(1).write.mode("append").parquet(src)


def _got(df):
    return sorted((r.kind, str(r.week_of), r.skill_name or "", -1 if r.id is None else r.id, r.n) for r in df.collect())


FIRST = [(1, "2024-01-02 10:00:00", ["sql", "SQL ", "go"]), (2, "2024-01-03 00:00:00", []), (3, "2024-01-20 00:00:00", ["go"]),
         (4, None, ["go"])]
LATE = [(5, "2024-01-04 00:00:00", ["rust"]), (6, "2024-01-05 00:00:00", None), (7, "2024-01-19 00:00:00", ["go"])]
AFTER = [(8, "2024-03-01 00:00:00", ["r"])]
CLOSED_1 = [("closed", "2024-01-01", "", -1, 2), ("closed", "2024-01-01", "go", -1, 1), ("closed", "2024-01-01", "sql", -1, 1)]
LATE_1 = [("late", "2024-01-01", "", 5, 1), ("late", "2024-01-01", "", 6, 1)]
CLOSED_2 = [("closed", "2024-01-15", "", -1, 2), ("closed", "2024-01-15", "go", -1, 2)]


def test_weeks_close_once_and_late_rows_are_kept(spark, tmp_dir):
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("src", "out", "ckpt"))
    run = lambda: closing.run_closing_weeks(spark, src, out, ckpt)
    _phase(spark, src, FIRST)
    run()
    # the watermark is 2024-01-13: the first week is closed, the third open
    assert _got(closing.read_closing_weeks(spark, out)) == CLOSED_1
    _phase(spark, src, LATE)
    run()
    assert _got(closing.read_closing_weeks(spark, out)) == sorted(CLOSED_1 + LATE_1)
    _phase(spark, src, AFTER)
    run()
    assert _got(closing.read_closing_weeks(spark, out)) == sorted(CLOSED_1 + LATE_1 + CLOSED_2)
    run()       # nothing new: nothing is emitted again
    assert _got(closing.read_closing_weeks(spark, out)) == sorted(CLOSED_1 + LATE_1 + CLOSED_2)


def test_compaction_keeps_the_table_and_leaves_old_batches_unread(spark, tmp_dir):
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("src", "out", "ckpt"))
    want = []
    for rows, new in ((FIRST, CLOSED_1), (LATE, LATE_1), (AFTER, CLOSED_2)):
        _phase(spark, src, rows)
        closing.run_closing_weeks(spark, src, out, ckpt)
        want = sorted(want + new)
        last = closing.compact(spark, out)
        assert closing.compacted_upto(spark, out) == last == closing.compact(spark, out)
        df = closing.read_closing_weeks(spark, out)
        assert _got(df) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"/compact/upto={last}" in plan and f"(batch_id#" in plan and f"> {last})" in plan
    # a replay of a folded batch changes nothing
    spark.createDataFrame([("late", None, None, 99, 1)], closing.OUT).write.mode("overwrite").parquet(f"{out}/batches/batch_id=0")
    assert _got(closing.read_closing_weeks(spark, out)) == want
    assert len(glob.glob(f"{out}/published/upto-*")) == 3


def test_a_compaction_that_was_not_published_is_not_read(spark, tmp_dir):
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("src", "out", "ckpt"))
    _phase(spark, src, FIRST)
    closing.run_closing_weeks(spark, src, out, ckpt)
    spark.createDataFrame([("late", None, None, 99, 1)], closing.OUT).write.parquet(f"{out}/compact/upto=1")
    assert _got(closing.read_closing_weeks(spark, out)) == CLOSED_1
    closing.compact(spark, out)
    assert _got(closing.read_closing_weeks(spark, out)) == CLOSED_1


def test_empty_stream(spark, tmp_dir):
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("src", "out", "ckpt"))
    _rows(spark, []).write.parquet(src)
    closing.run_closing_weeks(spark, src, out, ckpt)
    assert closing.read_closing_weeks(spark, out).collect() == []
