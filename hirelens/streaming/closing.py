"""Weekly counts with state of their own: late rows are rows of the
stream, and a week is emitted once, when it is closed.

``applyInPandasWithState`` keeps one number per (week, skill) of the open weeks. The watermark
closes a week: its counts leave as 'closed' rows by an event-time timeout and their state goes.
A row that comes after that is not dropped, it leaves as a 'late' row with its id. Spark
filters an operator's late input by its event-time column, so the rows get a second one that is
never late; the query's watermark is the smaller of the two, that of the analyses. A query with
two watermarks may have one stateful operator only, which ``ONE_OPERATOR`` states.

The total of a week is counted under ``SALTS`` keys, by a hash of the id, so that a week that
holds a third of all rows is spread over tasks; a reader adds them up. Rows of a key pass
through in batches, only their number is kept.

The sink appends folders of micro-batches, which ``compact`` folds into one (see ``folders``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelens.functions.text import week_monday
from hirelens.operators.trends import cleaned_list
from hirelens.session import shared_path
from hirelens.streaming import folders
from hirelens.streaming.folders import compacted_upto  # noqa: F401
from hirelens.streaming.weekly import SOURCE_SCHEMA, WATERMARK, utc_instant

SALTS = 16
NEVER = "2200-01-01 00:00:00"   # an event time that no watermark passes
OUT = "kind string, week_of date, skill_name string, id long, n long"
ONE_OPERATOR = "spark.sql.streaming.statefulOperator.allowMultiple"
_DAY_MS = 86_400_000
_EPOCH = dt.date(1970, 1, 1)


def _rows(kind: str, week: dt.date, skill: str | None, ids: list, n: int) -> pd.DataFrame:
    k = len(ids)
    return pd.DataFrame({"kind": [kind] * k, "week_of": [week] * k, "skill_name": pd.Series([skill] * k, dtype=object),
                         "id": pd.array(ids, dtype="Int64"), "n": [n] * k})


def _count_week(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One (week, skill, salt): count while the week is open, hand the count over when the
    watermark has passed its end, and hand on what comes later."""
    week, skill, _ = key
    if state.hasTimedOut:
        n, = state.get
        state.remove()
        yield _rows("closed", week, skill, [None], n)
        return
    end = (week - _EPOCH).days * _DAY_MS + 7 * _DAY_MS
    if end <= state.getCurrentWatermarkMs():
        for b in batches:
            if skill is None:      # the row that stands for the analysis itself
                yield _rows("late", week, None, b["id"].tolist(), 1)
        return
    n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
    state.update((n,))
    state.setTimeoutTimestamp(end)


def closing_weeks(stream: DataFrame, lateness: str = WATERMARK) -> DataFrame:
    """kind, week_of, skill_name, id, n of a stream of analyses (SOURCE_SCHEMA). Rows without
    created_at are in no week; weeks before 1970 are always late, since no watermark is below."""
    skills = F.array_distinct(F.coalesce(cleaned_list(F.col("required_skills")), F.array().cast("array<string>")))
    salt = F.when(F.col("skill_name").isNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = (stream.withColumn("ts", utc_instant(F.col("created_at"))).filter(F.col("ts").isNotNull())
            .withWatermark("ts", lateness)
            .select("id", week_monday(F.col("created_at")).alias("week_of"), F.lit(NEVER).cast("timestamp").alias("never"),
                    F.explode(F.concat(F.array(F.lit(None).cast("string")), skills)).alias("skill_name"))
            .withColumn("salt", salt).withWatermark("never", "0 seconds"))
    return rows.groupBy("week_of", "skill_name", "salt").applyInPandasWithState(
        _count_week, OUT, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_closing_weeks(spark: SparkSession, source_dir: str, out: str, ckpt: str,
                      lateness: str = WATERMARK, max_files: int | None = None) -> str:
    """Runs the stream over the files that the checkpoint has not seen and returns ``out``."""
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    weeks = closing_weeks(reader.parquet(source_dir), lateness)
    folders.start_sink(spark, out, weeks.schema)
    before = spark.conf.get(ONE_OPERATOR, None)
    spark.conf.set(ONE_OPERATOR, "false")       # a query takes the setting with it as it starts
    try:
        q = (weeks.writeStream.outputMode("append").foreachBatch(folders.write_batch(out))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(ONE_OPERATOR) if before is None else spark.conf.set(ONE_OPERATOR, before)
    q.awaitTermination()
    return out


def read_closing_weeks(spark: SparkSession, out: str) -> DataFrame:
    """kind, week_of, skill_name, id, n: a row per closed (week, skill), the null skill being
    the week's total, and a row per late analysis."""
    return _added_up(folders.read_batches(spark, out, OUT))


def _added_up(rows: DataFrame) -> DataFrame:
    rows = rows.drop("batch_id")
    closed = (rows.filter("kind = 'closed'").groupBy("kind", "week_of", "skill_name").agg(F.sum("n").alias("n"))
              .withColumn("id", F.lit(None).cast("long")))
    return rows.filter("kind = 'late'").unionByName(closed)


def compact(spark: SparkSession, out: str) -> int:
    """Folds every batch written so far into one folder; returns the last batch in it."""
    return folders.fold_batches(spark, out, OUT, _added_up)


def stream_in_phases(spark: SparkSession, phases: list[DataFrame], lateness: str = WATERMARK) -> str:
    """Hands each phase to the stream as new files and runs it on them, restarting from its
    checkpoint; the output is compacted after each but the last. Returns the output folder."""
    src, out, ckpt = (shared_path(spark, f"closing-weeks-{x}") for x in ("src", "out", "ckpt"))
    for i, rows in enumerate(phases):
        rows.select("id", "created_at", "required_skills").write.mode("append").parquet(src)
        run_closing_weeks(spark, src, out, ckpt, lateness)
        if i + 1 < len(phases):
            compact(spark, out)
    return out
