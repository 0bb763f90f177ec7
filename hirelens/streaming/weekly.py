"""Incremental weekly skill counts with Structured Streaming.

File source -> watermark on created_at -> tumbling 1-week windows that start on Monday
(the epoch is a Thursday, so ``startTime='4 days'``) -> count per (window, skill). One
stateful aggregation carries both the skill frequency and the weekly total: every
analysis contributes a null-skill row, whose count is the week's source_count.

The sink is ``foreachBatch`` in update mode: each micro-batch writes its changed
(window, skill) counts to its own folder under the shared checkpoint area, and from time to
time these are folded into one (see ``folders``); the table's current value is the latest
batch's row per key. Output and checkpoint folders are arguments: a query started
again with the same two resumes where it stopped and reads only new files.
Rows older than the watermark are dropped by Spark's state store (late data, ST2);
Spark judges lateness against the previous micro-batch's watermark, and ``late_rows``
counts them. Files of a backlog come in no particular event order, so a job over a backlog
takes its allowed lateness from the data (``backlog_lateness``): then no micro-batch
boundary can make a row late. State holds one count per (week, skill) of that span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.operators.trends import cleaned_list, trends_of
from hirelens.session import shared_path
from hirelens.streaming import folders

SOURCE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("required_skills", T.ArrayType(T.StringType())),
])

SINK = "w struct<start: timestamp, end: timestamp>, skill_name string, n long"
WATERMARK = "7 days"
WEEK_START = "4 days"     # shift from the Thursday epoch to Monday
MICRO_BATCHES = 4         # micro-batches a backlog is read in


def utc_instant(ntz: Column) -> Column:
    """A wall-clock (timestamp_ntz) read as UTC, as an instant. Watermarks need an
    instant; going through UTC explicitly keeps week edges off the session time zone."""
    return F.make_timestamp(F.year(ntz), F.month(ntz), F.dayofmonth(ntz), F.hour(ntz),
                            F.minute(ntz), F.date_part(F.lit("SECOND"), ntz), F.lit("UTC"))


def utc_date(instant: Column) -> Column:
    """The UTC calendar date of an instant (session time zone not involved)."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def backlog_lateness(analyses: DataFrame) -> str:
    """A watermark delay that covers the whole event-time span of ``analyses`` plus a week."""
    lo, hi = analyses.agg(F.min("created_at"), F.max("created_at")).first()
    return WATERMARK if lo is None else f"{(hi - lo).days + 8} days"


def weekly_counts(stream: DataFrame, lateness: str = WATERMARK) -> DataFrame:
    """The streaming aggregation (also usable on a batch DataFrame)."""
    ts = stream.withColumn("ts", utc_instant(F.col("created_at")))
    rows = ts.withWatermark("ts", lateness).select(
        F.window("ts", "1 week", startTime=WEEK_START).alias("w"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")),
                           F.coalesce(F.array_distinct(cleaned_list(F.col("required_skills"))),
                                      F.array().cast("array<string>")))).alias("skill_name"))
    return rows.groupBy("w", "skill_name").agg(F.count(F.lit(1)).alias("n"))


def run_weekly_stream(spark: SparkSession, source_dir: str, max_files: int | None = None,
                      out: str | None = None, ckpt: str | None = None,
                      lateness: str = WATERMARK) -> str:
    """Runs the stream over everything in ``source_dir`` (availableNow) that the checkpoint
    ``ckpt`` has not seen and returns the sink folder ``out``; fresh folders where they are
    not given. A source without files leaves an empty table."""
    out = out or shared_path(spark, "weekly-trends-out")
    ckpt = ckpt or shared_path(spark, "weekly-trends-ckpt")
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    agg = weekly_counts(reader.parquet(source_dir), lateness)
    folders.start_sink(spark, out, agg.schema)
    q = (agg.writeStream.outputMode("update").foreachBatch(folders.write_batch(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _latest(rows: DataFrame) -> DataFrame:
    """The newest count of every (week, skill)."""
    return rows.groupBy("w", "skill_name").agg(F.max_by("n", "batch_id").alias("n"))


def compact_weekly_table(spark: SparkSession, out: str) -> int:
    """Folds the batches so far into the newest count of every (week, skill), so that readers do
    not go through every update ever written; returns the last batch in it."""
    return folders.fold_batches(spark, out, SINK, _latest)


def read_weekly_table(spark: SparkSession, out: str) -> DataFrame:
    """Current skill_trends rows from the sink: latest batch per (week, skill), the
    weekly totals joined back."""
    cur = (_latest(folders.read_batches(spark, out, SINK)).withColumn("total", F.col("skill_name").isNull())
           .withColumn("week_of", utc_date(F.col("w.start"))))
    return trends_of(cur.select("week_of", "skill_name", F.col("n").cast("int").alias("n"), "total"))


def late_rows(spark: SparkSession, source_dir: str, out: str) -> DataFrame:
    """ST2: one row with the analyses in the source files, those counted in the table and
    the late ones that the watermark dropped (rows without ``created_at`` are in no week)."""
    src = spark.read.schema(SOURCE_SCHEMA).parquet(source_dir)
    seen = src.agg(F.count("created_at").alias("analyses"))
    kept = (folders.read_batches(spark, out, SINK).filter(F.col("skill_name").isNull())
            .groupBy("w").agg(F.max_by("n", "batch_id").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted")))
    both = seen.select("analyses", F.lit(0).cast("long").alias("counted")).unionByName(
        kept.select(F.lit(0).cast("long").alias("analyses"), "counted"))
    return (both.agg(F.sum("analyses").alias("analyses"), F.sum("counted").alias("counted"))
            .withColumn("late", F.col("analyses") - F.col("counted")))


def stream_weekly_trends(spark: SparkSession, analyses: DataFrame) -> DataFrame:
    """Writes the analyses snapshot as the stream's source files, runs the stream to
    the end of the available data in several micro-batches and returns the resulting
    weekly table, equal to the batch job's whatever the batches hold."""
    src = shared_path(spark, "weekly-trends-src")
    n = max(MICRO_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    analyses.select("id", "created_at", "required_skills").repartition(n, "id").write.parquet(src)
    written = spark.read.schema(SOURCE_SCHEMA).parquet(src)
    files = len(written.inputFiles())
    out = run_weekly_stream(spark, src, max_files=max(1, -(-files // MICRO_BATCHES)),
                            lateness=backlog_lateness(written))
    return read_weekly_table(spark, out)


def stream_weekly_in_phases(spark: SparkSession, phases: list[DataFrame], lateness: str) -> DataFrame:
    """Hands each phase to the stream as new files, restarts it on them from its checkpoint and
    folds the sink after it; returns the weekly table."""
    src, out, ckpt = (shared_path(spark, f"weekly-trends-{x}") for x in ("src", "out", "ckpt"))
    for rows in phases:
        rows.select("id", "created_at", "required_skills").write.mode("append").parquet(src)
        run_weekly_stream(spark, src, out=out, ckpt=ckpt, lateness=lateness)
        compact_weekly_table(spark, out)
    return read_weekly_table(spark, out)
